"""Node lookup, neighbourhoods, shortest paths and budget-bound expansion.

Traversals keep the order of a queue: a node found in a layer ranks by the rank
of the first frontier node that reaches it, then by its own place in the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import make_id
from ..functions.text import query_terms, tokens
from ..tables import PropertyGraph, stored
from .metrics import degree_directed, resolved_links, threshold_of

BUDGET, DEPTH = 1500, 2


def _tier(query: str) -> Column:
    """0 the canonical id, 1 equal, 2 prefix, 3 contained; null for no match."""
    term = F.array_join(tokens(F.lit(query)), " ")  # a constant to the optimiser
    label, nid = F.array_join(tokens(F.col("label")), " "), F.lower("id")
    fuzzy = F.when((label == term) | (nid == term), 1).when(label.startswith(term) | nid.startswith(term), 2).when(label.contains(term) | nid.contains(term), 3)
    return F.when(F.col("id") == make_id(query), 0).when(term != "", fuzzy).cast("long")


def find_nodes(graph: PropertyGraph, query: str) -> DataFrame:
    """``tier, ord, id, label`` of the nodes that match, best first: 0 the canonical id, 1 equal, 2 prefix, 3 contained."""
    return graph.nodes.where("id is not null").select(_tier(query).alias("tier"), "ord", "id", "label").where("tier is not null").orderBy("tier", "ord")


def find_best(graph: PropertyGraph, queries: list[str]) -> list[str | None]:
    """The best match of each query, all in one pass over the nodes."""
    if not queries:
        return []
    best = [F.min(F.when(_tier(q).isNotNull(), F.struct(_tier(q).alias("tier"), "ord", "id"))).alias(f"q{k}") for k, q in enumerate(queries)]
    return [r["id"] if r else None for r in graph.nodes.where("id is not null").agg(*best).first()]


def find_node(graph: PropertyGraph, query: str) -> str | None:
    return find_best(graph, [query])[0]


def labels_of(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.select("id", F.coalesce(F.nullif("label", F.lit("")), "id").alias("name"))


def neighbors(graph: PropertyGraph, node_id: str, relation_filter: str = "") -> DataFrame:
    """``direction, ord, neighbor, relation, confidence``: out-links, then in-links; the filter is part of the relation's name, case aside."""
    links = resolved_links(graph)
    names = labels_of(graph)
    out = links.where(F.col("source") == node_id).select(F.lit(0).alias("side"), F.lit("out").alias("direction"), "ord", F.col("target").alias("id"), "relation", "confidence")
    into = links.where(F.col("target") == node_id).select(F.lit(1).alias("side"), F.lit("in").alias("direction"), "ord", F.col("source").alias("id"), "relation", "confidence")
    rows = out.union(into).where(F.lower(F.coalesce("relation", F.lit(""))).contains(relation_filter.lower()))
    rows = rows.join(names, "id").orderBy("side", "ord")
    return rows.select("direction", "ord", F.col("name").alias("neighbor"), F.coalesce("relation", F.lit("")).alias("relation"), F.coalesce("confidence", F.lit("")).alias("confidence"))


@dataclass
class Explanation:
    id: str
    label: str
    source: str
    community: str
    degree: int
    connections: list[tuple[str, str, str, str]]

    def render(self) -> str:
        lines = [f"Node: {self.label}", f"  ID:        {self.id}", f"  Source:    {self.source}", f"  Community: {self.community}", f"  Degree:    {self.degree}"]
        if self.connections:
            lines += ["", f"Connections ({self.degree}):"]
            lines += [f"  {'-->' if way == 'out' else '<--'} {name} [{relation}] [{confidence}]" for way, name, relation, confidence in self.connections]
            if self.degree > len(self.connections):
                lines.append(f"  ... and {self.degree - len(self.connections)} more")
        return "\n".join(lines) + "\n"


def explain(graph: PropertyGraph, query: str, most: int = 20) -> Explanation | None:
    """The best match and its first connections; only those that are shown come to the driver."""
    node_id = find_node(graph, query)
    if node_id is None:
        return None
    node = graph.shaped().nodes.where(F.col("id") == node_id).orderBy("ord").first()
    near = neighbors(graph, node_id)
    shown = [(r["direction"], r["neighbor"], r["relation"], r["confidence"]) for r in near.limit(most).collect()]
    place = f"{node['source_file'] or ''} {node['source_location'] or ''}".strip()
    community = node["community_name"] or ("" if node["community"] is None else str(node["community"]))
    return Explanation(node_id, node["label"] or node_id, place, community, len(shown) if len(shown) < most else near.count(), shown)


def _places(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.where("id is not null").groupBy("id").agg(F.min("ord").alias("ord"))


def _ends(graph: PropertyGraph) -> DataFrame:
    """The ends of all links, stored once for the layers of a traversal; links of one pair and direction are one."""
    return stored(graph.links.select("source", "target").where("source is not null and target is not null").distinct())


def _reached(frontier: DataFrame, ends: DataFrame) -> DataFrame:
    """``frontier`` with ``near``: the other end of each link of its ids, in either direction."""
    names = frontier.columns
    out = frontier.join(ends, F.col("id") == F.col("source")).select(*names, F.col("target").alias("near"))
    return out.union(frontier.join(ends, F.col("id") == F.col("target")).select(*names, F.col("source").alias("near")))


def expand(graph: PropertyGraph, seeds: list[str], budget: int = BUDGET, depth: int = DEPTH) -> DataFrame:
    """``rank, id, parent, layer`` in order of discovery, at most ``budget`` nodes.

    Nodes that are no seeds and whose degree reaches the hub threshold are not
    expanded.  Only ``budget`` nodes are ever kept, so the ranking windows are small.
    """
    spark = graph.nodes.sparkSession
    start = [(i, s, None, 0) for i, s in enumerate(dict.fromkeys(seeds))]
    visited = spark.createDataFrame(start, "rank long, id string, parent string, layer int")
    n = len(start)
    if n and n < budget:
        graph = PropertyGraph(stored(graph.nodes.select("id", "ord")), stored(graph.links.select("source", "target")))
        places, ends = _places(graph), _ends(graph)
        frontier = visited.join(places.select("id"), "id", "left_semi").select("id", "rank")
        for layer in range(1, depth + 1):
            if layer == 2:  # seeds are expanded in any case
                degrees = stored(degree_directed(graph))
                limit = threshold_of(degrees).first()["hub_threshold"]
            if layer > 1:
                frontier = frontier.join(degrees, "id").where(F.col("degree") < limit).select("id", "rank")
            reached = _reached(frontier, ends).groupBy(F.col("near").alias("id")).agg(F.min(F.struct("rank", F.col("id").alias("parent"))).alias("by"))
            reached = reached.join(visited.select("id"), "id", "left_anti").join(places, "id")
            rows = reached.orderBy("by.rank", "ord").limit(budget - n).select("id", "ord", "by.rank", "by.parent")
            place = F.row_number().over(Window.orderBy("rank", "ord")) - 1 + n
            fresh = stored(rows.select(place.cast("long").alias("rank"), "id", "parent", F.lit(layer).alias("layer")))
            found = fresh.count()
            visited, frontier, n = visited.union(fresh), fresh.select("id", "rank"), n + found
            if not found or n >= budget:
                break
    return visited.orderBy("rank").limit(budget)


def expand_depth_first(graph: PropertyGraph, seeds: list[str], budget: int = BUDGET, depth: int = DEPTH) -> tuple[list[str], list[tuple[str, str]]]:
    """Nodes in order of a depth-first walk, and the links it took (they may repeat and may leave the node list).

    The walk itself is sequential; Spark cuts out the neighbourhood it can reach:
    nodes within ``depth`` steps of a seed, hubs not passed.
    """
    seeds = list(dict.fromkeys(seeds))
    graph = PropertyGraph(stored(graph.nodes.select("id", "ord")), stored(graph.links.select("source", "target")))
    places, ends, degrees = _places(graph), _ends(graph), stored(degree_directed(graph))
    limit = threshold_of(degrees).first()["hub_threshold"]
    spark = graph.nodes.sparkSession
    passed, near = places.where(F.col("id").isin(seeds)).select("id"), {}
    for _ in range(depth):
        rows = _reached(passed, ends).distinct().join(places.withColumnRenamed("id", "near"), "near").select("id", "near", "ord").collect()
        for r in rows:
            near.setdefault(r["id"], set()).add((r["ord"], r["near"]))
        fresh = [(x,) for x in sorted({r["near"] for r in rows} - set(near))]
        passed = spark.createDataFrame(fresh, "id string").join(degrees, "id").where(F.col("degree") < limit).select("id")
    walked, order, taken = set(), list(seeds), []
    known, waiting = set(seeds), [(s, 0) for s in reversed(seeds)]
    while waiting:
        node, at = waiting.pop()
        if node in walked:
            continue
        walked.add(node)
        if node not in known:
            known.add(node)
            order.append(node)
        if len(order) < budget and at < depth:
            for _, n in sorted(near.get(node, ()), reverse=True):
                if n not in walked:
                    taken.append((node, n))
                    waiting.append((n, at + 1))
    return order[:budget], taken


def seeds_of(graph: PropertyGraph, question: str) -> list[str]:
    """The best match of each content word, each once."""
    terms = graph.nodes.sparkSession.range(1).select(query_terms(F.lit(question)).alias("t")).first()["t"]
    return list(dict.fromkeys(x for x in find_best(graph, list(dict.fromkeys(terms))) if x))


def query(graph: PropertyGraph, question: str, budget: int = BUDGET, depth_first: bool = False) -> dict:
    """``mode, seeds, nodes, edges`` of the part of the graph that a question is about."""
    seeds = seeds_of(graph, question)
    if depth_first:
        nodes, edges = expand_depth_first(graph, seeds, budget) if seeds else ([], [])
    else:
        rows = expand(graph, seeds, budget).collect() if seeds else []  # at most budget rows
        nodes, edges = [r["id"] for r in rows], [(r["parent"], r["id"]) for r in rows if r["parent"]]
    return {"mode": "dfs" if depth_first else "bfs", "seeds": seeds, "nodes": nodes, "edges": edges}


def _layers(graph: PropertyGraph, ends: DataFrame, source: str, target: str) -> list[DataFrame] | None:
    """The nodes at each distance from ``source`` that lie on shortest paths to ``target`` (``id, ord``); None without a path.

    Layers grow from both ends, the smaller frontier first, until they meet.
    """
    places = _places(graph)
    sides = [[stored(places.where(F.col("id") == end))] for end in (source, target)]
    sizes = [side[0].count() for side in sides]
    if not all(sizes):
        return None
    met = sides[0][0] if source == target else None
    while met is None:
        k = sizes.index(min(sizes))
        seen = sides[k][-1].select("id") if len(sides[k]) == 1 else sides[k][-1].select("id").union(sides[k][-2].select("id"))
        # a neighbour of a layer lies in the one before, in itself, or in the next
        fresh = _reached(sides[k][-1].select("id"), ends).select(F.col("near").alias("id")).distinct().join(seen, "id", "left_anti")
        sides[k].append(stored(fresh.join(places, "id").select("id", "ord")))
        sizes[k] = sides[k][-1].count()
        if not sizes[k]:
            return None
        both = stored(sides[k][-1].join(sides[1 - k][-1].select("id"), "id", "left_semi"))
        met = None if both.isEmpty() else both
    out = [met]
    for side in sides:
        last = met
        for layer in reversed(side[:-1]):
            near = _reached(last.select("id"), ends).select(F.col("near").alias("id"))
            last = stored(layer.join(near, "id", "left_semi"))
            out.insert(0 if side is sides[0] else len(out), last)
    return out


def shortest_path(graph: PropertyGraph, source: str, target: str) -> DataFrame:
    """``hop, from_id, to_id, forward, relation, confidence`` of the first shortest undirected path; no rows if there is none.

    A queue takes neighbours in order of appearance, so its path is the one whose nodes come first,
    compared from the source on.  A link in the direction of the hop is preferred, of several the latest.
    """
    spark = graph.nodes.sparkSession
    graph = PropertyGraph(stored(graph.nodes.select("id", "ord")), stored(graph.links.select("ord", "source", "target", "relation", "confidence")))
    ends, hops = _ends(graph), []
    at = source
    for layer in (_layers(graph, ends, source, target) or [])[1:]:
        near = _reached(spark.createDataFrame([(at,)], "id string"), ends).select(F.col("near").alias("id"))
        step = layer.join(near, "id", "left_semi").orderBy("ord").first()["id"]
        hops.append((len(hops), at, step))
        at = step
    steps = F.broadcast(spark.createDataFrame(hops, "hop long, from_id string, to_id string"))  # one row for each hop
    link = lambda a, b: (F.col("source") == F.col(a)) & (F.col("target") == F.col(b))
    found = [steps.join(graph.links, link(*way)).select("hop", "from_id", "to_id", F.lit(way[0] == "from_id").alias("forward"), "ord", "relation", "confidence") for way in (("from_id", "to_id"), ("to_id", "from_id"))]
    best = found[0].union(found[1]).groupBy("hop", "from_id", "to_id").agg(F.max_by(F.struct("forward", "relation", "confidence"), F.struct("forward", "ord")).alias("b"))
    return best.select("hop", "from_id", "to_id", "b.forward", F.coalesce("b.relation", F.lit("")).alias("relation"), F.coalesce("b.confidence", F.lit("")).alias("confidence")).orderBy("hop")


def path(graph: PropertyGraph, a: str, b: str) -> DataFrame:
    """The shortest path between the best matches of two queries; an error if one has no match or both have the same."""
    ends = find_best(graph, [a, b])
    for q, end in zip((a, b), ends):
        if end is None:
            raise LookupError(f"No node matching '{q}' found.")
    if ends[0] == ends[1]:
        raise LookupError(f"'{a}' and '{b}' both resolved to the same node '{ends[0]}'. Use a more specific label or the exact node ID.")
    return shortest_path(graph, *ends)


def render_path(graph: PropertyGraph, hops: DataFrame) -> str:
    rows = hops.collect()
    names = {r["id"]: r["name"] for r in labels_of(graph).where(F.col("id").isin([x for r in rows for x in (r["from_id"], r["to_id"])])).collect()}
    text = names[rows[0]["from_id"]] if rows else ""
    for r in rows:
        mark = f"{r['relation'] or 'related'}" + (f" [{r['confidence']}]" if r["confidence"] else "")
        text += f" --{mark}--> {names[r['to_id']]}" if r["forward"] else f" <--{mark}-- {names[r['to_id']]}"
    return f"Shortest path ({len(rows)} hops):\n  {text}"
