"""A query for each language and format: the graph of a small file, and what it has to be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .samples import FOLDER, FOLDER_LINKS, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Relations between files; the others of the folder are stated by the samples.
_BETWEEN = ("imports", "imports_from", "dynamic_import")


def stated(name: str) -> list[tuple[str, ...]]:
    """``kind, a, b, c, d`` of each node (id, label, type) and link (source, relation, target, context)."""
    _, _, nodes, links = SAMPLES[name]
    rows = [("node", *line.strip().split(" | "), "-") for line in nodes.strip().splitlines()]
    return rows + [("link", *line.split()) for line in links.strip().splitlines()]


def _values(rows: list[tuple[str, ...]], names: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"select * from (values {quoted}) v({names})"


def _extracted(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    found = files.extract_files(spark.createDataFrame([(k, bytearray(v.encode())) for k, v in sources.items()], "file string, content binary")).graph
    nodes = found.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("file_type").alias("c"), F.lit("-").alias("d"))
    links = found.links.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c"), F.coalesce("context", F.lit("-")).alias("d"))
    return nodes.union(links)


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, source, _, _ = SAMPLES[name]
        return _extracted(spark, {path: source})

    return run


for _name in SAMPLES:
    QUERIES[f"extract_{_name}"] = _query(_name)
    ORACLE_SQL[f"extract_{_name}"] = _values(stated(_name), "kind, a, b, c, d")


def resolve_import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that name files of the folder without their endings or folders."""
    rows = _extracted(spark, FOLDER).where("kind = 'link'").where(F.col("b").isin(*_BETWEEN) | (F.col("d") == "script_invocation"))
    return rows.select(F.col("a").alias("source"), F.col("b").alias("relation"), F.col("c").alias("target"), F.col("d").alias("context"))


QUERIES["resolve_import_files"] = resolve_import_files
ORACLE_SQL["resolve_import_files"] = _values([tuple(line.split()) for line in FOLDER_LINKS.strip().splitlines()], "source, relation, target, context")
