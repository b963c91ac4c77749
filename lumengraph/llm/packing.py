"""Sequence packing by minimum bin slack over a histogram of lengths.

Documents are tokenised once.  Every full window of a document is a sequence of
its own; what remains of it (shorter than a window) is packed with other
remainders.  Packing looks only at the histogram of remaining lengths, at most
``window`` numbers however large the corpus is: a bitset subset-sum dynamic
program finds the multiset of lengths that fills a window closest to capacity,
backtracking gives the count of each length in it, and the same multiset is used
as often as the histogram allows.  A document's remainder then finds its place
from its rank among the remainders of equal length.  Full windows are not ranked.

Defined results: a null or empty text is one end token; a null id is kept;
repeated rows are packed each on its own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Texts of these characters only are split by the pattern below exactly as the byte-level pre-tokeniser splits them.
_PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧‰-⁞]*")
_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CACHE_ENTRIES = 300_000
#: Remainders of one length that are ranked together.
PER_PART = 100_000


def _ranked_merges(path: str):
    """The same merges in a faster engine, if the file's ids are their ranks; else None."""
    import tiktoken

    model = json.loads(open(path, encoding="utf-8").read())["model"]
    vocabulary = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(vocabulary.get(m) != 256 + i for i, m in enumerate(merged)) or sys.byteorder != "little":
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merged)}
    return tiktoken.Encoding("pairs", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, with a bounded cache of pieces between splits."""

    def __init__(self, path: str, plain_split: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain_split = plain_split
        self.cache: dict[str, bytes] = {}
        self.pairs = _ranked_merges(path) if plain_split else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> list[bytes]:
        if self.pairs is None:
            return self._whole(new)
        merge = self.pairs.encode_single_piece
        return [array("I", merge(p.encode())).tobytes() for p in new]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids, as if the tokeniser had been given the whole text."""
        for text in texts:
            if not self.plain_split or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
                yield self._whole([text])[0]
                continue
            pieces = _SPLIT.findall(text)
            try:
                yield b"".join(map(self.cache.__getitem__, pieces))
            except KeyError:
                if len(self.cache) > _CACHE_ENTRIES:
                    self.cache.clear()
                new = list({p for p in pieces if p not in self.cache})
                self.cache.update(zip(new, self._pieces(new)))
                yield b"".join(map(self.cache.__getitem__, pieces))


def _cutter(path: str, window: int, end_id: int, plain_split: bool, with_ids: bool) -> Callable:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = Encoder(path, plain_split), np.uint32(end_id).tobytes()
        for b in batches:
            out: list[tuple] = []
            for key, ids in zip(b["doc_id"], encoder.encode(b["text"].tolist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    out.append((key, at, len(piece) // 4, zlib.crc32(piece), n) + ((np.frombuffer(piece, "<u4").astype("int32"),) if with_ids else ()))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return scan


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``room`` from below.

    ``reached`` holds one bit for each sum that the lengths so far can make.
    Counts are split into powers of two, and backtracking adds them up again.
    """
    steps: list[tuple[int, int, int]] = []
    reached, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    for length in sorted((k for k in counts if k <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reached & goal:
            take = min(take, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & mask
            left, take = left - take, take * 2
        if reached & goal:
            break
    best, used = reached.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] += take
            best -= length * take
    return dict(used)


def bin_patterns(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(counts of lengths in a window, number of such windows), until the histogram is used up.

    Each window is seeded with the longest remaining length, the rest is filled
    with minimum slack.  A pattern repeats until one of its lengths runs short,
    so the number of patterns depends on ``window`` and not on the corpus.
    """
    left, patterns = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        pattern = Counter({seed: 1}) + Counter(fill({k: v for k, v in rest.items() if v}, window - seed))
        times = min(left[k] // n for k, n in pattern.items())
        patterns.append((dict(pattern), times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return patterns


def _placer(patterns: list[tuple[dict[int, int], int]]) -> Callable:
    """Rank among equal lengths -> sequence and offset, by binary search in that length's intervals."""
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            spans.setdefault(length, []).append((used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    tables = {k: np.array(v, dtype=np.int64) for k, v in spans.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, length = b.pop("rank").to_numpy(), b["length"].to_numpy()
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                t = tables[int(k)]
                low, n, first, start = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1].T
                seq[at], off[at] = first + (rank[at] - low) // n, start + (rank[at] - low) % n * k
            b["sequence_id"], b["offset"] = seq, off
            yield b

    return place


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", per_part: int = PER_PART, plain_split: bool = True, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset``.

    Remainders of one length are ranked in parts of about ``per_part``, so no task
    grows with the number of documents of a length.  ``plain_split`` is for
    byte-level vocabularies; others are given whole texts.  ``with_ids`` adds the
    token ids.  Ids may be of any type that text can be cast to.
    """
    spark = docs.sparkSession
    columns = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # ids are text in Python, which has no whole numbers beside nulls
    cutter = _cutter(tokenizer_path, window, end_id, plain_split, with_ids)
    with small_batches(spark):
        pieces = cut(rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(cutter, columns).withColumn("doc_id", F.col("doc_id").cast(id_type)))
    names = [c.split()[0] for c in columns.split(", ")]

    # the checkpoint's rows keep their places, so that these ids stay what they are when a task runs again
    rest = pieces.where(F.col("length") < window).withColumn("tie", F.monotonically_increasing_id())
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # fewer rows than the window has places
    patterns = bin_patterns(histogram, window)
    parts = F.broadcast(spark.createDataFrame([(k, -(-n // per_part)) for k, n in histogram.items()], "length long, parts int"))
    rest = rest.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("tie"), F.col("parts"))).drop("parts")
    # a row for each length and one for each per_part remainders
    bases, seen = [], Counter()
    for r in sorted(rest.groupBy("length", "part").count().collect()):
        bases.append((r["length"], r["part"], seen[r["length"]]))
        seen[r["length"]] += r["count"]
    bases = F.broadcast(spark.createDataFrame(bases, "length long, part long, base long"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("tie")) - 1
    ranked = rest.withColumn("rank", rank).join(bases, ["length", "part"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
    placed = ranked.select(*[F.col(c).cast("string") if c == "doc_id" else F.col(c) for c in names], "rank").mapInPandas(_placer(patterns), columns + ", sequence_id long, offset long")
    placed = placed.withColumn("doc_id", F.col("doc_id").cast(id_type))

    # a full window is a sequence by itself: numbered by its place in its partition
    full = pieces.where(F.col("length") == window).withColumn("tie", F.monotonically_increasing_id())
    part, firsts, sequence = F.shiftright("tie", 33), [], sum(times for _, times in patterns)
    for r in sorted(full.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        firsts.append((r["part"], sequence))
        sequence += r["count"]
    firsts = F.broadcast(spark.createDataFrame(firsts, "part long, first long"))
    full = full.withColumn("part", part).join(firsts, "part").select(*names, (F.col("first") + F.col("tie").bitwiseAND(F.lit((1 << 33) - 1))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed)
