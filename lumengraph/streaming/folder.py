"""A folder of source files as a stream: changed files replace what was extracted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import _ROW, _rows


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Extracts new files of ``folder`` in micro-batches into the Parquet table ``target``, one batch for each call of the trigger.

    Rows carry the batch they came with; :func:`current` keeps each file's latest.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    )
    rows = files.select(F.col("path").alias("file"), "content")

    def write(batch: DataFrame, number: int) -> None:
        batch.mapInPandas(_rows, _ROW).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame) -> DataFrame:
    """Each file's rows of its latest batch."""
    latest = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["file", "batch"])
