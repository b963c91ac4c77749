"""Ordered de-duplication and the repointing of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import symbol_key


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the attributes of its last row at the place of its first; rows without id go."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    last = nodes.where("id is not null").groupBy("id").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), "ord").alias("last"))
    return last.select(*[F.col(c) if c in ("id", "ord") else F.col(f"last.{c}").alias(c) for c in nodes.columns])


def dedupe_links(links: DataFrame) -> DataFrame:
    """The first link of each (source, target, relation); missing keys count as empty."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in ("source", "target", "relation")]
    first = links.groupBy(*key).agg(F.min_by(F.struct(*links.columns), "ord").alias("first"))
    return first.select("first.*")


def repoint(links: DataFrame, remap: DataFrame) -> DataFrame:
    """Both ends through ``remap`` (``from_id, to_id``), one hop."""
    names = links.columns
    for end in ("source", "target"):
        m = remap.select(F.col("from_id").alias(end), F.col("to_id").alias("_to"))
        links = links.join(m, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return links.select(*names)


#: Endings of labels that name files.
SOURCE_ENDINGS = (".py", ".js", ".ts", ".tsx", ".java", ".go", ".rs")


def names_file(label):
    return F.coalesce(label, F.lit("")).rlike(r"\.(py|js|ts|tsx|java|go|rs)$")


def resolvable(nodes: DataFrame):
    """Condition: a code symbol with a label that is no file name and has a key."""
    label = F.coalesce(F.col("label"), F.lit(""))
    return (F.col("file_type") == "code") & (F.regexp_replace(label, r"(?U)^\s+|\s+$", "") != "") & ~names_file(label) & (symbol_key(label) != "")


def collapse_stubs(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over the whole corpus, sourceless symbols give way to the one sourced symbol of their key, if there is exactly one."""
    remap = stub_remap(nodes)
    kept = nodes.join(remap.select(F.col("from_id").alias("id")), "id", "left_anti").select(*nodes.columns)
    return kept, repoint(links, remap)


def stub_remap(nodes: DataFrame) -> DataFrame:
    code = nodes.where(F.col("id").isNotNull() & resolvable(nodes)).withColumn("_key", symbol_key(F.col("label")))
    stub = F.coalesce(F.col("source_file"), F.lit("")) == ""
    # smallest and largest id tell whether there is one, without gathering them
    real = code.where(~stub).groupBy("_key").agg(F.min("id").alias("to_id"), F.max("id").alias("other")).where("to_id = other").drop("other")
    return code.where(stub).select("_key", F.col("id").alias("from_id")).distinct().join(real, "_key").where("from_id <> to_id").select("from_id", "to_id")
