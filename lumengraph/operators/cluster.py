"""Communities by modularity: exact and sequential for graphs that fit one task, synchronous for any size."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import PropertyGraph, dropped, stored
from .metrics import weighted_adjacency

RESOLUTION = 0.82
#: Adjacency rows and nodes up to which the exact mode is allowed; about 200 MB in one task.
EXACT_ROWS = 4_000_000
Weights = dict[int, dict[int, float]]


def _sweep(near: Weights, resolution: float) -> dict[int, int]:
    """Moves nodes in order, each to the community of largest gain, until none moves."""
    strength = {i: sum(n.values()) for i, n in near.items()}
    whole = sum(strength.values())
    home, load = {i: i for i in near}, dict(strength)
    moving = whole > 0
    while moving:
        moving = False
        for i, around in near.items():
            mine, pull = home[i], defaultdict(float)
            for j, w in sorted(around.items()):
                if j != i:
                    pull[home[j]] += w
            load[mine] -= strength[i]
            price = resolution * strength[i] / whole
            choice, value = mine, pull.get(mine, 0.0) - price * load[mine]
            for c in sorted(pull):
                offer = pull[c] - price * load[c]
                if offer > value + 1e-12:
                    choice, value = c, offer
            load[choice] += strength[i]
            if choice != mine:
                home[i], moving = choice, True
    return home


def louvain(near: Weights, resolution: float = RESOLUTION) -> dict[int, int]:
    """Community of each node of a symmetric weighted adjacency keyed 0..n-1."""
    place = {i: i for i in near}
    while True:
        home = _sweep(near, resolution)
        number: dict[int, int] = {}
        for i in near:
            number.setdefault(home[i], len(number))
        place = {i: number[home[s]] for i, s in place.items()}
        if len(number) == len(near):
            return place
        merged: Weights = {c: defaultdict(float) for c in range(len(number))}
        for i, around in near.items():
            for j, w in sorted(around.items()):
                merged[number[home[i]]][number[home[j]]] += w
        near = {c: dict(m) for c, m in merged.items()}


def _named(members: DataFrame) -> DataFrame:
    """Stable numbers: larger communities first, then by their sorted member lists."""
    groups = members.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # communities share no member, so their smallest members order their sorted lists
    number = (F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).cast("int")
    return members.join(groups.select("c", number.alias("community")), "c").select("id", "community")


def exact_communities(graph: PropertyGraph, resolution: float = RESOLUTION) -> DataFrame:
    """``id, community`` by sequential local moving in node order; for at most EXACT_ROWS adjacency rows and nodes."""
    adjacency = stored(weighted_adjacency(graph))
    if adjacency.count() + graph.nodes.count() > EXACT_ROWS:
        raise ValueError("the graph is too large for one task; use communities(mode='synchronous')")

    def one(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = nodes.sort_values("ord")["id"].tolist()
        at = {k: i for i, k in enumerate(ids)}
        near: Weights = {i: {} for i in range(len(ids))}
        for u, v, w in edges[["u", "v", "w"]].itertuples(index=False):
            near[at[u]][at[v]] = w
        found = louvain(near, resolution) if ids else {}
        return pd.DataFrame({"id": ids, "c": [found[i] for i in range(len(ids))]})

    nodes = graph.nodes.where("id is not null").groupBy("id").agg(F.min("ord").alias("ord")).withColumn("g", F.lit(0))
    found = nodes.groupBy("g").cogroup(adjacency.withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(one, "id string, c long")
    return _named(found)


def _moved(edges: DataFrame, labels: DataFrame, whole: float, resolution: float, most: int) -> DataFrame:
    """``id, k, c`` after local moving until no node gains by it; ``labels`` holds ``id, k, c``."""
    for r in range(most):
        load = labels.groupBy("c").agg(F.sum("k").alias("load"))
        mine = labels.select(F.col("id").alias("u"), "k", F.col("c").alias("own"))
        pull = edges.where("u <> v").join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("pull"))
        stay = mine.select("u", F.col("own").alias("c"), F.lit(0.0).alias("pull"))
        offers = pull.unionByName(stay).groupBy("u", "c").agg(F.sum("pull").alias("pull")).join(mine, "u").join(load, "c")
        without = F.col("load") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        offers = offers.withColumn("gain", F.round(F.col("pull") - resolution * F.col("k") * without / whole, 9))
        best = offers.groupBy("u").agg(F.max_by("c", F.struct("gain", (F.col("c") == F.col("own")), F.col("c"))).alias("best"))
        # half of the nodes may move, later fewer, so that neighbours don't change places for ever
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2 + r // 8)) == 0
        after = labels.join(best.select(F.col("u").alias("id"), "best"), "id", "left").withColumn("wants", F.coalesce(F.col("best") != F.col("c"), F.lit(False)))
        after = stored(after.select("id", "k", F.when(turn, F.coalesce("best", "c")).otherwise(F.col("c")).alias("c"), "wants"))
        over = after.where("wants").isEmpty()
        dropped(labels)
        labels = after
        if over:
            return labels.drop("wants")
    raise RuntimeError(f"communities still change after {most} rounds")


def synchronous_communities(graph: PropertyGraph, resolution: float = RESOLUTION, rounds: int = 200) -> DataFrame:
    """``id, community`` by local moving of part of the nodes at a time, with joins only, for graphs of any size.

    As in the sequential mode, nodes move until none gains, communities become nodes, and so on until
    nothing merges; as many nodes move at once, the partition may differ.  A node goes to the neighbouring
    community of largest gain, ties to the largest name.  ``rounds`` of one level without an end are an error.
    """
    edges = stored(weighted_adjacency(graph))
    whole = edges.agg(F.sum("w")).first()[0] or 1.0
    members = stored(graph.node_ids().distinct().withColumn("c", F.col("id")))
    while True:
        strength = edges.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
        labels = stored(members.select(F.col("c").alias("id")).distinct().join(strength, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("id").alias("c")))
        moved = _moved(edges, labels, whole, resolution, rounds).select("id", "c")
        if moved.where("id <> c").isEmpty():
            return _named(members)
        to = lambda end: moved.select(F.col("id").alias(end), F.col("c").alias(f"{end}2"))
        old = members, edges
        members = stored(members.join(moved.select(F.col("id").alias("c"), F.col("c").alias("home")), "c").select("id", F.col("home").alias("c")))
        edges = stored(edges.join(to("u"), "u").join(to("v"), "v").groupBy(F.col("u2").alias("u"), F.col("v2").alias("v")).agg(F.sum("w").alias("w")))
        dropped(*old)


def communities(graph: PropertyGraph, resolution: float = RESOLUTION, mode: str = "exact") -> DataFrame:
    return exact_communities(graph, resolution) if mode == "exact" else synchronous_communities(graph, resolution)
