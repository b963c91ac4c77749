"""Exact substring de-duplication with a sparse suffix array.

Every string of ``LENGTH`` bytes that also starts earlier in the corpus is
removed.  The suffix array is built by bucket-pointer refinement, but only where
strings can be equal:

1. Buckets by q-gram.  In each window of LENGTH bytes the q-gram with the smallest
   hash is its anchor; equal windows have the same anchor at the same place.  A run
   of neighbouring windows with one anchor is one row, in the bucket of its q-gram.
2. Refinement over tasks.  The q-gram buckets of all places are refined by pairs of
   bucket identifiers, of a place and of a later one, up to identifiers of LENGTH
   bytes, which serve all runs of a text; a run's identifier is the pair of its first
   and its last window's.  A bucket is sorted by them: of runs of equal identifiers
   all but the first are removed; a run whose bucket holds no other is unique.
3. Refinement inside a task.  What is left are runs that share an anchor and differ
   elsewhere, around the edges of repeated passages.  They are cut into blocks of
   windows with a common core and sorted by identifiers that are ranks: buckets of 8
   bytes, then repeatedly by the pair of identifiers of a place and of a later one.
4. Hot buckets.  A q-gram that stands in very many documents would send them all to
   one task.  Those that a sample of the documents shows are spread at once: each of
   their windows goes by its own identifier.  A bucket of more than ``hot`` different
   runs that the sample did not show is found in step 2, and its windows are spread
   then.  Either way only the place where rows meet differs, never what is removed.

Runs are combined inside each batch of documents before any shuffle, so a passage
that a third of all documents share costs one row for each batch, not one for
each document.  Only runs, blocks and verdicts are shuffled by content; texts meet
their verdicts by document.

Defined results: texts are UTF-8 bytes, null is empty; matches never cross
documents; documents are ordered by id (null first), those of one id by a hash of
their text; rows alike in id and text count as one document and get the same
result; ids are whole numbers above -2**62, other types are refused; texts of one id
are told apart by 19 bits of a hash; texts shorter than LENGTH are kept whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

LENGTH = 100
QGRAM = 32
WINDOWS = LENGTH - QGRAM + 1
#: Bytes of text handled at a time; bounds the arrays below.
BLOCK_BYTES = 1 << 20
#: Windows of a block, counted from the anchor.
BLOCK = 24
#: Different runs of a bucket that are sorted in one task, and one of how many documents is looked at for hot buckets.
HOT, SAMPLE = 1000, 64
#: Buckets that are spread from the start, at most; the others that are hot are found later.
SPREAD = 10_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def _qgrams(data: np.ndarray) -> np.ndarray:
    """Hash of the QGRAM bytes from each place on."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    for width in (8, 16):
        x = _mix(x[:-width] ^ _mix(x[width:] + np.uint64(width)))
    return x


def _refined(bucket: np.ndarray) -> np.ndarray:
    """Bucket identifiers of LENGTH bytes from each place on, refined from the q-gram buckets.

    Each round names the pair of a place's bucket and that of a later place, so that the identifiers of
    one round are those by which the next one sorts.  Names are hashes of the pairs: equal in all tasks.
    """
    depth = QGRAM
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        bucket = _mix(bucket[:-step] ^ _mix(bucket[step:] + np.uint64(step)))
        depth += step
    return bucket


def _content(windows: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Identifier of ``size`` bytes (LENGTH to 2 * LENGTH): the pair of its first and its last window's, which cover it."""
    return _mix(_mix(windows[start] + size.astype(np.uint64)) ^ windows[start + size - LENGTH])


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes); long texts are cut with an overlap of one window."""
    part, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), BLOCK_BYTES):
            piece = t[at : at + BLOCK_BYTES + LENGTH - 1]
            part.append((i, at, piece))
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield part
                part, size = [], 0
    if part:
        yield part


def runs(texts: list[bytes], spread: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows - 1, anchor - first window, bucket, identifier) of each run, in order.

    Windows of buckets in ``spread`` (sorted) follow as rows of their own, with their identifiers as buckets.
    """
    out = []
    for part in _pieces(texts):
        data = np.frombuffer(b"".join(p for _, _, p in part) + b"\0" * LENGTH, np.uint8)
        q = _qgrams(data)
        windows = _refined(q)
        least = (q & ~np.uint64(0xFFFFFF)) | np.arange(len(q), dtype=np.uint64)
        for width in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-width], least[width:])
        least = np.minimum(least[: 64 - WINDOWS], least[WINDOWS - 64 :])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        lengths = np.array([len(p) for _, _, p in part])
        first = np.cumsum(lengths) - lengths
        n = lengths - LENGTH + 1
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        piece = np.repeat(np.arange(len(part)), n)
        a = anchor[at]
        head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (piece[1:] != piece[:-1]))))
        count = np.diff(np.concatenate((head, [len(a)])))
        start, a, piece = at[head], a[head], piece[head]
        number = np.array([i for i, _, _ in part])[piece]
        offset = np.array([o for _, o, _ in part])[piece] - first[piece]
        content = _mix(_content(windows, start, count - 1 + LENGTH) ^ (a - start).astype(np.uint64))
        rows = (number, start + offset, count - 1, a - start, q[a], content)
        if spread is not None and len(spread):
            hot = spread[np.minimum(np.searchsorted(spread, q[a]), len(spread) - 1)] == q[a]
            each = np.repeat(start[hot], count[hot]) + np.arange(count[hot].sum()) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
            zero = np.zeros(len(each), np.int64)
            single = (np.repeat(number[hot], count[hot]), each + np.repeat(offset[hot], count[hot]), zero, zero, windows[each], _second(q, each))
            rows = tuple(np.concatenate((x[~hot], y)) for x, y in zip(rows, single))
        out.append(rows)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _second(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another hash of the window at each place, from its first and last q-gram."""
    return _mix(q[at] + q[at + LENGTH - QGRAM])


# A place in one number, in order of document part, first window; then windows - 1 and the anchor's distance.
# Negative (complemented) where the verdict is known to be "removed".
def _pack(sub, start, span, off):
    return (sub.astype(np.int64) << 44) | (start.astype(np.int64) << 13) | (span.astype(np.int64) * WINDOWS + off.astype(np.int64))


def _unpack(place):
    low = place & ((1 << 13) - 1)
    return place >> 44, (place >> 13) & ((1 << 31) - 1), low // WINDOWS, low % WINDOWS


def _combined(bucket: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """One batch's rows, ordered by document: of equal rows all but the first are settled here."""
    bucket, content = bucket.view(np.int64), content.view(np.int64)
    key = bucket ^ (content << 1)
    order = np.argsort(key, kind="stable")
    k, d, p = key[order], doc[order], place[order]
    head = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    later = (d != d[first]) | (p != p[first])
    spread = _mix((d ^ (p << 7)).view(np.uint64)).view(np.int64)
    return pd.DataFrame({"bucket": np.where(later, spread, bucket[order]), "content": np.where(later, 0, content[order]), "doc": d, "place": np.where(later, ~p, p)})


def _scan_runs(spread: np.ndarray | None) -> Callable:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["doc", "sub"])
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            number, start, span, off, bucket, content = runs(texts, spread)
            yield _combined(bucket.astype(np.uint64), content.astype(np.uint64), b["doc"].to_numpy()[number], _pack(b["sub"].to_numpy()[number], start, span, off))

    return scan


def _verdicts(ask: bool, most: int = HOT) -> Callable:
    """Rows sorted by bucket, content, document, place: ``doc, sub, start, count, off, state``.

    State 1: removed.  With ``ask``, runs that are the first of their content in a
    bucket of several contents get state 2, or 3 where the contents are more than ``most``.
    """

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # bucket, content, doc, place of the current content's first row
        held: list[tuple[np.ndarray, np.ndarray]] = []  # firsts of the current bucket, until it is known to be hot or over
        n_held, hot = 0, False

        def frame(doc, place, state):
            sub, start, span, off = _unpack(place)
            return pd.DataFrame({"doc": doc, "sub": sub, "start": start, "count": span + 1, "off": off, "state": np.int32(state)})

        def flush():
            nonlocal held, n_held, hot
            if n_held > 1:
                yield frame(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), 2)
            held, n_held, hot = [], 0, False

        for b in batches:
            bucket, content, doc, place = (b[c].to_numpy() for c in ("bucket", "content", "doc", "place"))
            known = place < 0
            if known.any():
                yield frame(doc[known], ~place[known], 1)
                bucket, content, doc, place = (x[~known] for x in (bucket, content, doc, place))
            if not len(bucket):
                continue
            new_bucket = np.concatenate(([last is None or bucket[0] != last[0]], bucket[1:] != bucket[:-1]))
            new = new_bucket | np.concatenate(([last is None or content[0] != last[1]], content[1:] != content[:-1]))
            # each row's first: the latest new row, or the one carried over from the batch before
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_doc = np.where(at >= 0, doc[at], last[2] if last else 0)
            first_place = np.where(at >= 0, place[at], last[3] if last else 0)
            gone = ~new & ((doc != first_doc) | (place != first_place))
            if gone.any():
                yield frame(doc[gone], place[gone], 1)
            last = (bucket[-1], content[-1], first_doc[-1], first_place[-1])
            if not ask:
                continue
            firsts = np.flatnonzero(new)
            if not len(firsts):
                continue
            # the first group may go on from the batch before, the last into the next; those between are whole
            group = np.cumsum(new_bucket[firsts])
            sizes = np.bincount(group)
            whole = (group > group[0]) & (group < group[-1])
            for part, state in ((whole & (sizes[group] > 1) & (sizes[group] <= most), 2), (whole & (sizes[group] > most), 3)):
                if part.any():
                    yield frame(doc[firsts[part]], place[firsts[part]], state)
            for at in dict.fromkeys((group[0], group[-1])):
                part = firsts[group == at]
                if new_bucket[part[0]]:
                    yield from flush()
                held.append((doc[part], place[part]))
                n_held += len(part)
                if n_held > most or hot:
                    yield frame(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), 3)
                    held, n_held, hot = [], 0, True
        yield from flush()

    return settle


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of windows around the anchors in question: ``core, doc, sub, start, body``."""
    for b in batches:
        rows = []
        for doc, sub, text, asks in zip(b["doc"], b["sub"], b["text"], b["asks"]):
            t = text.encode("utf-8", "surrogatepass")
            for ask in asks:
                start, last, a = ask["start"], ask["start"] + ask["count"] - 1, ask["start"] + ask["off"]
                # window p stands in block (a - p) // BLOCK; every window of a block holds its core
                for k in range((a - last) // BLOCK, (a - start) // BLOCK + 1):
                    low, high = max(start, a - BLOCK * k - BLOCK + 1), min(last, a - BLOCK * k)
                    core = hashlib.blake2b(t[a - BLOCK * k : a - BLOCK * k - BLOCK + 1 + LENGTH], digest_size=16, key=bytes([k]))
                    core.update(t[a : a + QGRAM])
                    rows.append((core.digest(), doc, sub, low, t[low : high + LENGTH]))
        yield pd.DataFrame(rows, columns=["core", "doc", "sub", "start", "body"])


def refine(bodies: list[bytes]) -> np.ndarray:
    """Bucket identifiers of all windows of LENGTH bytes, body after body: equal for equal windows, in order of content."""
    data = np.frombuffer(b"".join(bodies) + b"\0" * LENGTH, np.uint8)
    x = data.astype(np.uint64)
    for width in (1, 2, 4):  # first byte highest, so that numbers sort like strings
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    pointer = np.unique(x, return_inverse=True)[1].astype(np.int64)
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        pair = pointer[:-step] * (int(pointer.max()) + 1) + pointer[step:]
        pointer = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth += step
    lengths = np.array([len(x) for x in bodies])
    n = lengths - LENGTH + 1
    at = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return pointer[at]


def _sorted_out(part: pd.DataFrame) -> pd.DataFrame:
    """Removed windows of blocks (ordered by core, doc, sub, start; whole cores) as runs."""
    bodies = part["body"].tolist()
    n = np.array([len(x) for x in bodies]) - LENGTH + 1
    row = np.repeat(np.arange(len(part)), n)
    start = part["start"].to_numpy()[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, sub = part["doc"].to_numpy()[row], part["sub"].to_numpy()[row]
    pointer = refine(bodies)
    order = np.lexsort((start, sub, doc, pointer))
    p = pointer[order]
    head = np.concatenate(([True], p[1:] != p[:-1]))
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))]
    gone = (doc[order] != doc[first]) | (sub[order] != sub[first]) | (start[order] != start[first])
    out = pd.DataFrame({"doc": doc[order][gone], "sub": sub[order][gone], "start": start[order][gone]}).sort_values(["doc", "sub", "start"]).drop_duplicates()
    d, s, w = (out[c].to_numpy() for c in ("doc", "sub", "start"))
    if not len(d):
        return pd.DataFrame({"doc": d, "sub": s, "start": w, "count": w})
    head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1))))
    return pd.DataFrame({"doc": d[head], "sub": s[head], "start": w[head], "count": np.diff(np.concatenate((head, [len(d)])))})


def _settle_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by core, doc, sub, start.  Cores of one row repeat nowhere; a core has at most HOT runs."""
    rest: list[pd.DataFrame] = []

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[frame.duplicated("core", keep=False)]

    for b in batches:
        if not len(b):
            continue
        whole = pd.concat([*rest, b], ignore_index=True)
        open_ = whole["core"] == whole["core"].iloc[-1]
        ready, rest = shared(whole[~open_]), [whole[open_]]
        for at in _chunks(ready):
            yield _sorted_out(ready.iloc[at[0] : at[1]])
    ready = shared(pd.concat(rest, ignore_index=True)) if rest else pd.DataFrame()
    if len(ready):
        yield _sorted_out(ready)


def _chunks(frame: pd.DataFrame, rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Stretches of about so many rows that end with a core."""
    core, at = frame["core"].tolist(), 0
    for i in range(1, len(core) + 1):
        if i == len(core) or (i - at >= rows and core[i] != core[i - 1]):
            yield at, i
            at = i


def _hot_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of the runs in question as a row of its own, by its content."""
    for b in batches:
        b = b.sort_values(["doc", "sub"])
        docs, places, one, two = [], [], [], []
        for doc, sub, text, asks in zip(b["doc"], b["sub"], b["text"], b["asks"]):
            t = text.encode("utf-8", "surrogatepass")
            for ask in sorted(asks, key=lambda x: x["start"]):
                q = _qgrams(np.frombuffer(t[ask["start"] : ask["start"] + ask["count"] - 1 + LENGTH], np.uint8))
                at = np.arange(ask["count"])
                zero = np.zeros(len(at), np.int64)
                one.append(_refined(q)), two.append(_second(q, at)), docs.append(zero + doc), places.append(_pack(zero + sub, ask["start"] + at, zero, zero))
        if docs:
            yield _combined(*(np.concatenate(x) for x in (one, two, docs, places)))


def _apply(keep_text: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, gone in zip(b.pop("text"), b.pop("gone")):
                t = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for start, count in sorted((g["start"], g["count"]) for g in gone) if gone is not None else ():
                    end = start + count - 1 + LENGTH
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                at, kept = 0, []
                for start, end in spans:
                    kept.append(t[at:start])
                    at = end
                left = b"".join(kept) + t[at:]
                out.append((len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()) + ((left,) if keep_text else ()))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return scan


def _hot_buckets(rows: DataFrame, hot: int) -> np.ndarray:
    """The buckets with the most rows in a sample of the documents, at most SPREAD of them, sorted."""
    sample = rows.where(F.pmod(F.xxhash64("doc", "sub"), F.lit(SAMPLE)) == 0).mapInPandas(_scan_runs(None), "bucket long, content long, doc long, place long")
    counts = sample.where("place >= 0").groupBy("bucket").count().where(F.col("count") > max(1, 2 * hot // SAMPLE))
    return np.sort(np.array([r["bucket"] for r in counts.orderBy(F.desc("count"), "bucket").limit(SPREAD).collect()], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]`` (``kept``: the remaining bytes)."""
    spark, kind = docs.sparkSession, docs.select(F.col(id_col)).schema[0].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"documents are ordered by whole-number ids; {id_col} is {kind.simpleString()}")
    text, number = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    # documents without id stand in front of all others, each at a place of its own
    doc = F.coalesce(number, F.xxhash64(text).bitwiseOR(F.lit(-(2**63))).bitwiseAND(F.lit(~(1 << 62))))
    source = docs.select(number.alias("doc_id"), doc.alias("doc"), F.xxhash64(text).bitwiseAND(F.lit((1 << 19) - 1)).alias("sub"), text.alias("text"))
    row = "bucket long, content long, doc long, place long"
    order = ["bucket", "content", "doc", "place"]
    verdict = "doc long, sub long, start long, count long, off long, state int"
    with small_batches(spark):
        rows = source.select("doc", "sub", "text")
        found = rows.mapInPandas(_scan_runs(_hot_buckets(rows, hot)), row)
        # equal documents give equal rows; they stay and get the same verdict
        found = stored(found.repartition("bucket").sortWithinPartitions(*order).mapInPandas(_verdicts(True, hot), verdict))

        # texts are shuffled by document once: both joins below read the same exchange
        asked = lambda state: found.where(F.col("state") == state).groupBy("doc", "sub").agg(F.collect_set(F.struct("start", "count", "off")).alias("asks"))
        blocks = source.join(asked(2), ["doc", "sub"]).select("doc", "sub", "text", "asks").mapInPandas(_blocks, "core binary, doc long, sub long, start long, body binary")
        gone = "doc long, sub long, start long, count long"
        sorted_ = blocks.repartition("core").sortWithinPartitions("core", "doc", "sub", "start").mapInPandas(_settle_blocks, gone)
        late = source.join(asked(3), ["doc", "sub"]).select("doc", "sub", "text", "asks").mapInPandas(_hot_windows, row)
        late = late.repartition("bucket").sortWithinPartitions(*order).mapInPandas(_verdicts(False), verdict)
        names = ["doc", "sub", "start", "count"]
        removed = found.where("state = 1").select(*names).union(sorted_).union(late.select(*names))
        removed = removed.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "count")).alias("gone"))
        # ids are text in Python, which has no whole numbers beside nulls
        columns = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
        out = source.join(removed, ["doc", "sub"], "left").select(F.col("doc_id").cast("string"), "text", "gone").mapInPandas(_apply(keep_text), columns)
        return stored(out.withColumn("doc_id", F.col("doc_id").cast("long")))
