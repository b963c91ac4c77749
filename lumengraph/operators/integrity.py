"""Schema checks and reference checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import CONFIDENCES, PropertyGraph


def validation_errors(graph: PropertyGraph) -> DataFrame:
    """``kind, ord, detail``: missing ids, each further use of an id, links without source, target or relation, unknown confidences.

    One pass over the links; of the nodes only those meet whose id is used again.
    """
    nodes, links = graph.nodes.select("ord", "id"), graph.links
    fault = lambda kind, detail, when: F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    missing = nodes.where("id is null").select(F.lit("missing id").alias("kind"), "ord", F.lit("id").alias("detail"))
    first = nodes.where("id is not null").groupBy("id").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = nodes.join(first, "id").where("ord <> first").select(F.lit("duplicate id").alias("kind"), "ord", F.col("id").alias("detail"))
    faults = [fault("missing key", F.lit(k), F.col(k).isNull()) for k in ("source", "target", "relation")]
    faults.append(fault("invalid confidence", F.col("confidence"), ~F.col("confidence").isin(*CONFIDENCES)))
    bad = F.col("source").isNull() | F.col("target").isNull() | F.col("relation").isNull() | ~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(True))
    wrong = links.where(bad).select("ord", F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull())).alias("f")).select("f.kind", "ord", "f.detail")
    return missing.union(again).union(wrong)


def dangling_links(graph: PropertyGraph) -> DataFrame:
    """``ord, end, id``: a row for each end of a link that names no node."""
    ends = graph.links.select("ord", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source").alias("id")), F.struct(F.lit("target").alias("end"), F.col("target").alias("id")))).alias("e"))
    ends = ends.select("ord", "e.*").where("id is not null")
    return ends.join(graph.node_ids(), "id", "left_anti").select("ord", "end", "id")
