"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import dropped, scratch, stored

__all__ = ["BATCH_BYTES", "UPPER", "WORD", "cut", "dropped", "lower_ascii", "packed", "small_batches", "stored", "table"]

#: Words of the contracts: maximal runs of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that one batch hands to Python in steps that are run by the operator itself.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``row`` with all columns of ``docs`` as they are, and ``columns``, whose names can't clash with theirs."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage there."""
    scratch(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands texts to Python in batches of at most BATCH_BYTES, where the session sets nothing else.

    The session's setting is put back at the end.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if before == "67108864b":  # the default
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before == "67108864b":
            spark.conf.unset(key)
