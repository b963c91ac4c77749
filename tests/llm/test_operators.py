"""Small cases of every corpus operator against plain Python, and the odd inputs of each."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumengraph.llm import chat, classifier, decontaminate, licenses, neardup, packing, rules, secrets, sharding, substrings

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, size long, kept string"
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, "é 日本 😀 naïve"), (7, "word " * 20_000), (8, "x" * 50_000)]


def frame(spark, rows):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 0, "k") for r in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        own = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 12])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own) if i % 7 else "\n".join(rng.choices(base, k=2))))
    return rows


# --- sharding


def test_shards_are_contiguous_and_even(spark):
    rows = corpus(200) + ODD[:7]
    got = sorted((r for r in sharding.shard_by_bytes(frame(spark, rows).repartition(5), 8).collect()), key=lambda r: (r["shard"], r["slot"]))
    assert len(got) == len(rows)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    for s in range(8):
        part = [r for r in got if r["shard"] == s]
        assert [r["slot"] for r in part] == list(range(len(part)))
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert {(r["size"], r["text_crc32"]) for r in got} == {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows}


def test_sharding_an_empty_table(spark):
    assert sharding.shard_by_bytes(frame(spark, ODD).limit(0)).count() == 0


# --- packing


def test_pack_is_a_partition_of_the_tokens(spark):
    rows = [(0 if k is None else k, t) for k, t in ODD] + corpus(40, 2)
    got = packing.pack(frame(spark, rows), TOKENIZER, 128, with_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for key, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 128):
            want[key, at, len(ids), tuple(ids[at : at + 128])] += 1
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], tuple(r["ids"])) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(frame(spark, rows).limit(0), TOKENIZER).count() == 0


def test_pack_in_parts_and_by_other_ids(spark):
    rows = [(f"id {k % 9}" if k % 5 else None, t) for k, t in corpus(40, 2) + [(1, "same text")] * 60]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, length int, tie int")
    got = packing.pack(df.repartition(4), TOKENIZER, 64, per_part=3).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 64
    assert sorted(bins) == list(range(len(bins)))
    lengths = Counter(len(packing.Encoder(TOKENIZER)._whole([t or ""])[0]) // 4 + 1 for _, t in rows)
    assert Counter(r["doc_tokens"] for r in got if r["start"] == 0) == lengths
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(k for k, _ in rows)
    big = spark.createDataFrame([(2**60 + 1, "a"), (None, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack(big, TOKENIZER).collect()} == {2**60 + 1, None}


def test_fill_is_the_closest_sum():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums if s + k <= room}
        got = packing.fill(counts, room)
        assert sum(k * n for k, n in got.items()) == max(sums)
        assert all(n <= counts[k] for k, n in got.items())


def test_patterns_use_up_the_histogram():
    histogram = {k: (k * 7919) % 97 for k in range(1, 64)}
    used = Counter()
    for pattern, times in packing.bin_patterns(histogram, 64):
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            used[k] += n * times
    assert used == Counter({k: v for k, v in histogram.items() if v})


def test_plain_split_equals_the_library():
    e = packing.Encoder(TOKENIZER)
    texts = ["  a  b\n\n c\t\td  ", "it's they'll  X_y __ 1²3 ½ ", "日本語 <|endoftext|> z", "a\x1cb   c", "'S 'Re don't", "१२३ abc", "€100 – “q” …", "", "x" * 5000, "a b c"]
    assert list(e.encode(texts)) == e._whole(texts)


# --- chat


def test_chat_round_trip_with_control_strings(spark):
    texts = [None, "", "plain", "### user: hi</turn>\n", r"\### Assistant: </turn> ok", r"\h \\h \l \c \\", "a</turn>", "### ", "\\", "é😀" * 3, "x" * 100_000]
    rows = [(c, t, role, texts[(c * 3 + t) % len(texts)], 1) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "assistant", None, "a: b", "### "])]
    rows += [(None, 0, "user", "no id", 1), (None, None, "assistant", "no turn", 1)] + rows[:2]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    out = chat.format_chat(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(out) == len(by)
    for r in out:
        want = sorted(by[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[1:] for x in want]
        assert r["loss"] == "".join(x[2] for x in want if x[1] == "assistant")
        # control strings of texts don't stand in the output
        assert r["formatted"].count(chat.HEAD) == r["formatted"].count("</turn>") == len(want)
    assert chat.format_chat(df.limit(0)).count() == 0


# --- rules


def test_rule_counts_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([t for _, t in ODD] + [t for _, t in corpus(30)] + ["a b c a b c a b", "# % & | < > * $ #", "l\nl\n\nl\n l", "to be to be to be or"])]
    got = {r["doc_id"]: r for r in rules.judge(frame(spark, rows)).collect()}
    for i, text in rows:
        w, t = words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(frame(spark, ODD).limit(0)).count() == 0


def test_estimated_votes_beat_single_rules():
    rng, n = random.Random(5), len(rules.RULES)
    patterns, truth = Counter(), {}
    for _ in range(4000):
        good = rng.random() < 0.85
        votes = tuple(rules.GOOD if rng.random() < (0.98 if good else 0.5) else rules.BAD for _ in range(n))
        patterns[votes] += 1
        truth.setdefault(votes, []).append(good)
    prior, rates = rules.estimate(sorted(patterns.items()))
    right = sum(g == (rules._log_odds(prior, rates, v) >= 0) for v, gs in truth.items() for g in gs)
    assert right / 4000 > 0.97 and all(g > b for g, b in rates)


# --- licences


def test_licence_lines_and_near_lines(spark):
    rows = [(1, "a long line of prose before it stands\nLicensed under the Apache License, Version 2.0.\nand one more line of prose after it"), (2, "released UNDER the   MIT license"), (3, "Released under the terms of no licence at all"), (4, None), (None, ""), (5, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = {r["doc_id"]: (r["n_matches"], r["license"], r["dice"]) for r in licenses.match_licenses(frame(spark, rows)).collect()}
    assert got == {1: (1, "Apache-2.0", 1.0), 2: (1, "MIT", 1.0), 3: (0, None, None), 4: (0, None, None), None: (0, None, None), 5: (2, "CC-BY-NC-4.0", 1.0)}


# --- decontamination


def brute_hits(docs, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    known = {}
    for key, text in items:
        w = split(text)
        k = min(width, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            known.setdefault(tuple(w[j : j + k]), set()).add(key)
    out = []
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for k in {len(x) for x in known}:
            for j in range(len(w) - k + 1):
                if ids := known.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= ids
        out.append((key, len(w), len(hit), tuple(sorted(map(str, found)))))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["ab", "É", "é", "x1", "Zed", "zed", "the", "of"] + ["w%d" % i for i in range(25)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(1, text(40)), (2, text(12)), (3, text(10)), (4, "Zed x1"), (5, ""), (6, None), (7, "w1"), (8, text(15)), (8, text(11))]
    docs = [(i, text(30) + " " + (rng.choice(items)[1] or "") + "! " + text(20)) for i in range(60)]
    docs += [(100, items[0][1].upper()), (101, items[0][1].replace(" ", "--\n")), (102, None), (103, "--"), (None, items[1][1]), (104, "w1"), (105, "w1"), (105, "w1"), (106, "É"), (107, (items[0][1] + " ") * 400)]
    df, bench = frame(spark, docs), spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id long")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(df, bench).collect()]
    assert Counter(got) == Counter(brute_hits(docs, items))
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    decontaminate_rows = decontaminate.BROADCAST_ROWS
    try:
        decontaminate.BROADCAST_ROWS = -1
        again = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(df, bench).collect()]
    finally:
        decontaminate.BROADCAST_ROWS = decontaminate_rows
    assert Counter(again) == Counter(got)


def brute_near(docs, items, width=10, slop=3):
    """For each document row the items of which a window stands nearly, by the definition in the module's docstring."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    texts = [split(t) for _, t in docs]
    counts = Counter(w for t in texts for w in t)
    places = [{w: [i for i, x in enumerate(t) if x == w] for w in set(t)} for t in texts]
    found = [set() for _ in docs]
    for key, w in {(key, tuple(split(text))) for key, text in items}:
        need = min(width, len(w))
        for i in range(len(w) - need + 1 if w else 0):
            window, least = w[i : i + need], need - need // 5
            ranked = sorted((counts[t], off, t) for off, t in enumerate(window) if counts[t])
            if len(ranked) < least:
                continue
            rare = ranked[:3]
            for n, (_, off, term) in enumerate(rare[: max(len(rare) - 1, 1)]):
                others = {o for _, o, _ in rare[n + 1 :] or rare}
                for at, out in zip(places, found):
                    for p in at.get(term, ()):
                        near = {k for k, t in enumerate(window) if any(abs(q - (p - off + k)) <= slop for q in at.get(t, ()))}
                        if len(near) >= least and near & others:
                            out.add(key)
    return [len(f) for f in found]


def test_stored_index_gives_the_same_matches(spark, tmp_path):
    rng = random.Random(29)
    text = lambda n: " ".join(rng.choices(["a", "b", "The", "É", "w1", "w2", "w3"] + ["x%d" % i for i in range(30)], k=n))
    items = [(1, text(25)), (2, text(9)), (3, text(11)), (4, None)]
    docs = [(i, text(15) + " " + (rng.choice(items)[1] or "") + "; " + text(5)) for i in range(40)] + [(None, items[0][1]), (90, None)]
    decontaminate.store_index(frame(spark, docs), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    ids = {(r["doc"], r["text_key"]): r["doc_id"] for r in index.where("term is null").collect()}
    assert len(ids) == len(docs)
    words_ = decontaminate.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    item_ids = {r["item_key"]: r["item_id"] for r in words_.collect()}
    hits = {}
    for r in decontaminate.search(index, words_).collect():
        places, found = hits.setdefault(ids[r["doc"], r["text_key"]], (set(), set()))
        places |= set(range(r["first"], r["last"] + 1))
        found.add(str(item_ids[r["item_key"]]))
    got = {k: (len(p), tuple(sorted(f))) for k, (p, f) in hits.items()}
    assert got == {k: (n, f) for k, _, n, f in brute_hits(docs, items) if n}


def test_proximity_finds_changed_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, "one two three four five six"), (3, "solo")], "item_id long, text string")
    texts = [item.replace(" eta theta", " eta and theta"), "kappa then nothing at all", "x " + item.replace("delta", "other") + " y", "one two THREE and four five six", "one six", "so Solo", None, "lambda kappa alpha"]
    got = [(r["n_near"], r["n_hit"]) for r in decontaminate.contamination(frame(spark, list(enumerate(texts))), items).orderBy("doc_id").collect()]
    assert got == [(1, 0), (0, 0), (1, 0), (1, 0), (0, 0), (1, 1), (0, 0), (0, 0)]


def test_proximity_equals_brute_force(spark):
    rng = random.Random(31)
    vocabulary = ["É", "é", "the", "of"] + ["w%d" % i for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((30, 12, 10, 7, 4, 2, 1))] + [(7, "never seen anywhere"), (7, None)]
    docs = []
    for i in range(80):
        own = (rng.choice(items)[1] or "").split(" ")
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randint(0, 1)] = rng.choice([[], ["zz"], [rng.choice(vocabulary)] * 2])
        docs.append((i, " ".join(rng.choices(vocabulary, k=20) + own + rng.choices(vocabulary, k=20))))
    docs += [(200, None), (201, "w1 " * 3000), (202, docs[0][1]), (202, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(decontaminate.contamination(frame(spark, docs), bench).collect(), key=lambda r: r["doc_id"])
    assert [r["n_near"] for r in rows] == brute_near(docs, items)


# --- near-duplicates


def brute_components(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = words(low(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low_id = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        ids = [x for x in (low_id.get(r), key) if x is not None]
        low_id[r] = min(ids) if ids else None
    return [(k, len(s), low_id[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rows = ODD + [(100 + k, t) for k, t in corpus(160, 4)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), width).collect())
    assert got == Counter(brute_components(rows, width))


def test_near_misses_of_one_text(spark):
    """Copies with so many edits that many pairs lie just below and above the threshold."""
    rng = random.Random(11)
    base = ["w%d" % i for i in range(150)]
    rows = []
    for i in range(220):
        own = list(base)
        for k in rng.sample(range(150), rng.randint(0, 14)):
            own[k] = "e%d" % rng.randrange(10**6)
        rows.append((i + 1, " ".join(own)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), 2).collect())
    assert got == Counter(brute_components(rows, 2))


def test_bitmaps_rule_out_large_sets_and_no_link():
    """Sets of every size: all links stay possible, and of the others those of 0.7 and less hardly ever do."""
    rng = np.random.default_rng(5)

    def near(x, y):
        record = lambda s, name: name * 16 + name * 16 + len(s).to_bytes(4, "big") + neardup._bitmap(np.sort(s))
        batch = pd.DataFrame({"xs": [[record(x, b"x")]], "ys": [[record(y, b"y")]]})
        return sum(len(b) for b in neardup._near(80, 4)([batch]))

    for n in (1, 5, 9, 100, 480, 500, 2000, 2100, 9000):
        pool = rng.integers(0, 2**64, 2 * n, np.uint64, endpoint=False)
        own = lambda k: (pool[:n], np.concatenate([pool[k:n], pool[n : n + k]]))
        assert near(*own(n // 9)) and near(pool[:n], pool[: n + n // 4]) and near(pool[:n], pool[:n])
        if n >= 480:
            assert not near(*own(3 * n // 17 + 1))  # 0.7
            assert not near(pool[:n], pool[: n + n // 4 + 1])


def test_classes_of_many_pairs_are_copied(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PER_COPY", 2)
    base = ["w%d" % i for i in range(150)]
    rows = [(i + 1, " ".join(base[:i] + ["e%d" % i] + base[i + 1 :])) for i in range(60)] + [(99, "else entirely")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), 2).collect())
    assert got == Counter(brute_components(rows, 2))


def test_one_of_each_group_stays(spark):
    text = " ".join("w%d" % i for i in range(80))
    rows = [(3, text), (2, text + " more"), (2, text + " more"), (None, text), (9, None), (9, None), (None, ""), (4, "else entirely")]
    out = neardup.keep_one(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "size", "kept"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(2, text + " more"), (9, None), (None, ""), (4, "else entirely")])
    assert neardup.keep_one(frame(spark, rows).limit(0)).count() == 0


# --- substrings


def brute_repeats(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        b, gone = text.encode(), bytearray(len(text.encode()))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(13)
    passage = "".join(rng.choice("abcd é") for _ in range(180))
    own = lambda n: "".join(rng.choice("abcdefgh ijk") for _ in range(n))
    rows = [(i, own(rng.randint(0, 300)) + passage[rng.randint(0, 40) : rng.randint(120, 180)] + own(rng.randint(0, 200))) for i in range(60)]
    rows += [(200, "a" * 5000), (201, "ab" * 400), (202, "a" * 150), (203, rows[5][1]), (204, rows[5][1] + "!"), (205, "é" * 60), (206, "é" * 60), (207, "short"), (208, "short"), (209, "x" * 99), (210, "y" * 100), (211, "y" * 100)]
    return rows


def test_removed_bytes_equal_brute_force(spark):
    rows = repeat_rows()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(frame(spark, rows).repartition(6)).collect()}
    assert got == brute_repeats(rows)


def phrase_rows():
    """One phrase of less than LENGTH bytes in many documents, each time between other words, and repeats around it."""
    rng = random.Random(41)
    phrase = "this very common phrase of some seventy bytes stands in all the documents here"
    own = lambda n: "".join(rng.choice("abcdefgh ijk") for _ in range(n))
    beside = [own(60) for _ in range(4)]
    return [(i, own(50) + rng.choice(beside) + phrase + rng.choice(beside) + own(40)) for i in range(150)]


@pytest.mark.parametrize("shown", [True, False])
def test_hot_buckets_give_the_same(spark, monkeypatch, shown):
    """With buckets of over three runs spread: all of them from the start, or none before they are found."""
    rows = repeat_rows() + [(1000 + k, t) for k, t in phrase_rows()]
    buckets = substrings.runs([t.encode() for _, t in rows])[4]
    most = Counter(buckets.tolist())
    monkeypatch.setattr(substrings, "_hot_buckets", lambda rows, hot: np.array(sorted(k for k, n in most.items() if shown and n > hot), np.uint64))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(frame(spark, rows).repartition(6), hot=3).collect()}
    assert got == brute_repeats(rows)
    assert max(most.values()) > 100


def test_sample_shows_hot_buckets(spark):
    rows = [(k, t) for n in range(20) for k, t in ((n * 1000 + k, f"{n} {t} {n}") for k, t in phrase_rows())]
    source = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "xxhash64(text) & 524287 as sub", "text")
    buckets = Counter(substrings.runs([t.encode() for _, t in rows])[4].tolist())
    found = substrings._hot_buckets(source, 200).tolist()
    assert found and max(buckets, key=buckets.get) in found and all(buckets[k] > 100 for k in found)


def test_small_blocks_cover_every_window(monkeypatch):
    texts = [t.encode() for _, t in repeat_rows()]
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 200)
    number, start, span, off, _, _ = substrings.runs(texts)
    for i, t in enumerate(texts):
        at = np.concatenate([np.arange(s, s + c + 1) for s, c in zip(start[number == i], span[number == i])]) if (number == i).any() else np.zeros(0, int)
        assert list(at) == list(range(max(len(t) - 99, 0)))


def test_places_are_packed_without_loss():
    rng = np.random.default_rng(3)
    parts = rng.integers(0, 1 << 19, 1000), rng.integers(0, 1 << 31, 1000), rng.integers(0, 69, 1000), rng.integers(0, 69, 1000)
    place = substrings._pack(*parts)
    assert (place >= 0).all() and all((a == b).all() for a, b in zip(substrings._unpack(place), parts))


def test_odd_rows_of_substrings(spark):
    rows = [(None, None), (None, "z" * 130), (None, "y" * 120), (1, None), (2, ""), (5, "z" * 120), (5, "z" * 120), (5, "y" * 110)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    # the first 100 bytes of a run of one letter are the first of their kind, the rest repeats them; rows alike get the same result
    assert got == Counter({(None, 0, 0): 1, (None, 130, 129): 1, (None, 120, 119): 1, (1, 0, 0): 1, (2, 0, 0): 1, (5, 120, 120): 2, (5, 110, 110): 1})
    assert substrings.remove_repeats(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(TypeError, match="whole-number ids"):
        substrings.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_refine_tells_windows_apart():
    rng = random.Random(17)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 123))) for _ in range(8)]
    bodies += [bodies[0], bodies[1][1:] + b"a" * 5]
    windows = [b[i : i + 100] for b in bodies for i in range(len(b) - 99)]
    pointer = substrings.refine(bodies)
    assert [sorted(set(windows)).index(w) for w in windows] == [sorted(set(pointer)).index(p) for p in pointer]


# --- classifier


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.random((n, classifier.WIDTH)).astype(np.float32) for n in (1, 3, 2)]
    labels = np.array([1.0, 0.0, 1.0], np.float32)
    model = classifier.train(bags, labels, hidden=5, steps=1)
    model.weights = {k: np.asarray(v, np.float64) for k, v in model.weights.items()}
    rows, first = np.concatenate(bags), np.array([0, 1, 4])
    loss = lambda: -np.mean(np.log(np.where(labels == 1, model._forward(rows, first)["p"], 1 - model._forward(rows, first)["p"])))
    grads = model.gradients(rows, first, labels)
    for k in ("W", "V", "U", "w", "c", "b"):
        at = tuple(rng.integers(0, s) for s in model.weights[k].shape)
        keep = model.weights[k][at]
        model.weights[k][at] = keep + 1e-4
        up = loss()
        model.weights[k][at] = keep - 1e-4
        slope = (up - loss()) / 2e-4
        model.weights[k][at] = keep
        assert abs(slope - grads[k][at]) < 1e-4 + 0.02 * abs(slope)


def test_classifier_learns_held_out_documents(spark):
    rng = random.Random(19)
    good = lambda: " ".join(rng.choice(["the", "river", "went", "over", "stones", "and", "fields."]) + str(rng.randrange(9)) for _ in range(150))
    bad = lambda: " ".join(["BUY!! $$$"] * 80)
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(None, None), (500, ""), (500, "")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(240)] + [(None, 1, "x"), (501, None, "x")], "doc_id long, quality int, text string")
    model = classifier.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in classifier.score(df, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert classifier.score(df, model).count() == len(rows)
    assert {r["score"] for r in classifier.score(df, classifier.fit(df, labels.limit(0))).collect()} == {0.5}
    assert classifier.keep_good(df, model).columns == df.columns
    assert classifier.score(df.limit(0), model).count() == 0


# --- licences


def license_matches(spark, texts):
    rows = licenses.match_licenses(frame(spark, list(enumerate(texts)))).collect()
    return [[(m["license"], m["dice"]) for m in r["matches"]] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_bounds_are_on_distinct_bigrams(spark):
    assert license_matches(spark, ["Released under the MIT License. " * 3]) == [[("MIT", 0.888889)]]


def test_notices_inside_lines_and_over_lines(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    full = dict(licenses.FULL_TEXTS)
    texts = [
        "See the notes. Released under the MIT License. All rights reserved by us.",
        f"{filler}\nThis work is licensed under the GNU\nGeneral Public License, version\n3. {filler}",
        full["MIT"],
        f"{filler}\n{full['MIT']}\n{filler}",
        f"{filler} {full['BSD-3-Clause']} {filler} Released under the MIT License, {filler}",
        f"x\x01Released under the\x01MIT License\x01 {filler}",
        "of the license under the software as the mit " * 20,
        None,
    ]
    assert license_matches(spark, texts) == [[("MIT", 1.0)], [("GPL-3.0", 1.0)], [("MIT", 1.0)], [("MIT", 1.0)], [("BSD-3-Clause", 1.0), ("MIT", 1.0)], [("MIT", 1.0)], [], []]


def test_best_window_equals_brute_force(spark):
    """All windows of texts made of the words of notices, with repeats."""
    rng = random.Random(37)
    known = [(n, set(g)) for n, t in licenses.TEMPLATES for g in [licenses.bigrams_of(t)[0]]]
    texts = []
    for _ in range(60):
        own = re.findall(licenses.TERM, low(" ".join(rng.choice(licenses.TEMPLATES)[1] for _ in range(2))))
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = rng.choice([["the"], [own[at]] * 3, ["zz"]])
        texts.append(" ".join(["aa"] * 2 + own))
    for text, got in zip(texts, license_matches(spark, texts)):
        grams = [f"{a} {b}" for a, b in zip(text.split(" "), text.split(" ")[1:])]
        best = max(2 * len(w & g) / (len(w) + len(g)) for i in range(len(grams)) for j in range(i, len(grams)) for w in [set(grams[i : j + 1])] for _, g in known)
        line = max(2 * len(set(grams) & g) / (len(set(grams)) + len(g)) for _, g in known)
        # a line that matches is one match by itself
        want = line if line >= 0.8 else best
        assert max((d for _, d in got), default=None) == (pytest.approx(want, abs=1e-6) if want >= 0.8 else None), text


# --- columns of the caller


def test_stages_keep_columns_of_any_name(spark):
    names = ["_key", "_id", "score", "_spans", "_hit_id", "_passages", "_rid", "_rkey", "_hit_key", "row", "id", "key", "raw", "doc", "text_key", "a.b", "Marks"]
    rows = [(k, t, *[f"{n} {k}" for n in names]) for k, t in [(1, "token=abcdefgh é and more words of a text"), (None, "another text with other words"), (3, None)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, "unrelated words of an item")], "item_id long, text string")
    stages = {
        "redact": secrets.redact(df), "keep_one": neardup.keep_one(df), "keep_good": classifier.keep_good(df, None), "keep_clean": decontaminate.keep_clean(df, items),
    }
    for name, out in stages.items():
        assert out.columns == df.columns, name
        want = [tuple(r) if name != "redact" else (r[0], r[1] and r[1].replace("token=abcdefgh", "[assign]"), *r[2:]) for r in rows]
        assert Counter(map(tuple, out.collect())) == Counter(want), name


def test_session_settings_stay(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")}
    neardup.keep_one(frame(spark, ODD[:4])).count()
    assert {k: spark.conf.get(k) for k in before} == before
