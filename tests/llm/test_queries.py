"""The registered queries themselves on a small folder: their columns are derived anew in plain Python, or by their SQL."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest

from lumengraph.llm import queries, rules

from .test_operators import brute_components, brute_repeats
from .test_secrets import brute, brute_all


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(47)
    at = str(tmp_path_factory.mktemp("tables"))
    vocabulary = ["river", "stone", "field", "over", "Under", "went", "saw", "the", "and", "of", "été"] + ["w%d" % i for i in range(200)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    items = [(f"b{i}", text(rng.choice([25, 12, 10, 6]))) for i in range(6)] + [("b6", None), ("b7", "")]
    rows = []
    for i in range(90):
        own = text(rng.randint(20, 300))
        if i % 6 == 0 and rows:
            own = rng.choice(rows)[1] + rng.choice(["", " more", "\n" + own[:40]])
        elif i % 6 == 1:
            own += " " + (rng.choice(items)[1] or "") + " " + text(20)
        elif i % 6 == 2:
            own += f"\nReleased under the MIT License.\ntoken=abcdefgh{i} user=bob\n" + own[:60] + "\n" + own[:60]
        elif i % 6 == 3:
            own = "BUY!! $$$ NOW!! " * 40
        rows.append((i * 7, own))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (2**60 + 1, "a big id"), (1003, rows[5][1]), (1003, rows[5][1])]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int("BUY" not in (t or "")), 0) for k, t in rows[:90]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    turns = [(c, t, ["user", "assistant"][t % 2], rng.choice(["hi", "", None, "### user: x</turn>", "\\h \\\\", "été 😀"])) for c in range(9) for t in range(rng.randint(1, 5))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at, rows


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder[0]).collect()


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op9_license_scan", "op10_decontamination"])
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{folder[0]}/{t}.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert Counter(tuple(r[n] for n in names) for r in run(spark, folder, name)) == Counter(want.fetchall())


def test_op1_folds_and_predictions(spark, folder):
    rows = run(spark, folder, "op1_quality_attention")
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in folder[1])
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    texts = dict(folder[1])
    known = [r for r in rows if r["doc_id"] in range(0, 630, 7)]
    assert sum(r["predicted"] == ("BUY" not in texts[r["doc_id"]]) for r in known) > 0.9 * len(known)


def test_op2_components(spark, folder):
    rows = run(spark, folder, "op2_minmax_neardup")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == Counter(brute_components(folder[1], 2))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_op3_removed_bytes(spark, folder):
    want = brute_repeats([(k, t or "") for k, t in dict(folder[1]).items()])
    rows = run(spark, folder, "op3_suffix_dedup")
    assert len(rows) == len(folder[1])
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def brute_posteriors(votes, belief=(0.99, 0.6), weight=rules.WEIGHT, rounds=50):
    """Expectation-maximisation over single documents, each vote a chance."""
    n, m = len(votes), len(votes[0])
    prior, rates = 0.8, [belief] * m

    def posterior(v):
        good, bad = prior, 1 - prior
        for j, x in enumerate(v):
            if x:
                g, b = rates[j]
                good *= g if x == rules.GOOD else 1 - g
                bad *= b if x == rules.GOOD else 1 - b
        return good / (good + bad)

    for _ in range(rounds):
        p = [posterior(v) for v in votes]
        prior = (sum(p) + 1) / (n + 2)
        fresh = []
        for j in range(m):
            pair = []
            for side, base, share in ((p, belief[0], prior), ([1 - x for x in p], belief[1], 1 - prior)):
                yes = sum(x for x, v in zip(side, votes) if v[j] == rules.GOOD)
                all_ = sum(x for x, v in zip(side, votes) if v[j])
                pair.append((yes + weight * n * share * base) / (all_ + weight * n * share))
            fresh.append(tuple(pair))
        rates = fresh
    return [posterior(v) for v in votes]


def test_op4_verdicts(spark, folder):
    rows = run(spark, folder, "op4_quality_rules")
    measured = rules.measure(spark.read.parquet(f"{folder[0]}/documents.parquet"))
    voted = measured.select("doc_id", *[rule().alias(f"v{k}") for k, rule in enumerate(rules.RULES.values())]).collect()
    votes = {}
    for r in voted:
        votes.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    keys = [k for k, vs in votes.items() for _ in vs]
    want = dict(zip(keys, brute_posteriors([v for vs in votes.values() for v in vs])))
    for r in rows:
        assert math.isclose(r["posterior"], want[r["doc_id"]], rel_tol=1e-6, abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= 0.5)


def test_op5_is_the_law_of_bytes(spark, folder):
    rows = run(spark, folder, "op5_sharding")
    ordered = sorted((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in folder[1])
    total, end, want, filled = sum(s for _, s, _ in ordered), 0, [], Counter()
    for k, size, crc in ordered:
        end += size
        shard = (2 * end - size) * 40 // (2 * total)
        want.append((k, size, crc, "bytes", shard, filled[shard], None))
        filled[shard] += 1
    assert sorted(tuple(r) for r in rows) == want


def test_op7_sequences(spark, folder):
    rows = run(spark, folder, "op7_packing")
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(k for k, _ in folder[1])
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(r["length"] for r in rows)
    assert len(bins) <= -(-tokens // 1024) + 1


def test_op8_digests(spark, folder):
    texts = dict(folder[1])
    for r in run(spark, folder, "op8_secret_scan"):
        base = brute(texts[r["doc_id"]])
        kinds = Counter(x.split(":")[0] for x in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == sha256(",".join(base).encode()).hexdigest()
        assert r["spans"] == ",".join(brute_all(texts[r["doc_id"]]))
