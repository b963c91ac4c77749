"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (columns ``a, b``); ``comp`` is one of the component's nodes.

    Each round lets every component join its smallest neighbour if that is
    smaller than itself, follows the resulting chains to their ends, and relabels
    the edges; edges inside a component drop out.  Components at least halve in
    number each round.  Nothing is collected but whether edges are left.
    """
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node")))
    left = stored(edges.where("a <> b").distinct())
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("comp"), F.least("a", "b").alias("parent"))
        parent = stored(parent)
        while True:  # pointers jump twice in one go; depths go down to a quarter
            far = parent.select(F.col("comp").alias("parent"), F.col("parent").alias("top"))
            twice = parent.join(far, "parent").select("comp", F.col("top").alias("parent"))
            far = twice.select(F.col("comp").alias("parent"), F.col("parent").alias("top"))
            jumped = stored(twice.join(far, "parent").select("comp", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            dropped(parent)
            parent = jumped
            if not moved:
                break
        old, labels = labels, stored(labels.join(parent, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")))
        to = lambda c: parent.select(F.col("comp").alias(c), F.col("parent").alias(f"{c}2"))
        passed, left = left, stored(left.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
        dropped(old, passed, parent)
    dropped(left)
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of a graph that has got more edges: only components that these join are contracted again."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    merged = components(between.where("a <> b"))
    fresh = merged.select("node").join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
    top = merged.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    out = stored(labels.select("node", "comp").union(fresh).join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
    dropped(labels, merged)
    return out
