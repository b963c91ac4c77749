"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned in document order, each partition reports its byte
and row totals (one small row per partition), and the running totals of the
partitions in front give every row its global byte offset.  Shard boundaries lie
at equal multiples of the grand total, so a shard is a contiguous run of
documents and its size differs from the target by less than one document.

Defined results: a null text counts as empty (size = ``overhead``); a null id
sorts first; rows with equal ids are ordered by size and checksum and may lie in
neighbouring shards; equal texts are not grouped, because a group of copies may
outweigh a shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _running(offsets: dict[int, tuple[int, int]], total: int, shards: int):
    """Per-partition scan that carries its running totals from batch to batch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, row = offsets.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            ends = before + b["size"].cumsum()
            # the shard in which the middle byte of the document falls
            b["shard"] = ((2 * ends - b["size"]) * shards // (2 * total)).astype("int32")
            b["row"] = range(row, row + len(b))
            before, row = int(ends.iloc[-1]) if len(b) else before, row + len(b)
            yield b

    return scan


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``slot`` counts from 0 inside a shard without gaps, in document order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # the last key only spreads rows that agree in everything else
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = ["doc_id", "size", "text_crc32", "_tie"]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie"))

    totals = placed.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    offsets, before, row = {}, 0, 0
    for t in sorted(totals):
        offsets[t["pid"]] = (before, row)
        before, row = before + t["bytes"], row + t["rows"]

    # ids are text in Python, which has no whole numbers beside nulls
    marked = placed.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_running(offsets, max(before, 1), shards), "doc_id string, size long, text_crc32 long, shard int, row long")
    marked = marked.withColumn("doc_id", F.col("doc_id").cast(placed.schema["doc_id"].dataType))
    first = {r["shard"]: r["row"] for r in marked.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return marked.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.get(starts, F.col("shard"))).alias("slot"))
