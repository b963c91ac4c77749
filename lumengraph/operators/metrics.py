"""Degrees, weights, predicates, rankings and report figures of a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename
from ..tables import PropertyGraph

#: Names of builtins, mocks and typing helpers that are never core entities.
BUILTIN_NAMES = (
    "str int float bool bytes bytearray complex object True False MagicMock Mock AsyncMock NonCallableMock NonCallableMagicMock PropertyMock "
    "patch sentinel Path Any Optional List Dict Set Tuple Union Callable Type ClassVar Final Literal Protocol Counter defaultdict OrderedDict "
    "datetime Enum os sys re json io abc typing"
).split()
#: Keys of JSON files that are never core entities.
JSON_KEYS = (
    "start end name id type properties value key data items title description version dependencies devdependencies peerdependencies "
    "optionaldependencies bundleddependencies bundledependencies"
).split()
#: Relations that say where something is, not how it is used.
STRUCTURAL = ("imports", "imports_from", "contains", "method")


def resolved_links(graph: PropertyGraph) -> DataFrame:
    """Links whose ends both name nodes; two semi joins on the id."""
    ids = graph.node_ids().distinct()
    for end in ("source", "target"):
        links = graph.links if end == "source" else links  # noqa: F821
        links = links.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return links.select(*graph.links.columns)


def _with_zeros(graph: PropertyGraph, ends: DataFrame) -> DataFrame:
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return graph.node_ids().distinct().join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_undirected(graph: PropertyGraph) -> DataFrame:
    """Incident resolved links; a self-loop counts once."""
    return _with_zeros(graph, resolved_links(graph).select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")))


def degree_directed(graph: PropertyGraph) -> DataFrame:
    """In- plus out-links, resolved; a self-loop counts twice."""
    return _with_zeros(graph, resolved_links(graph).select(F.explode(F.array("source", "target")).alias("id")))


def degree_export(graph: PropertyGraph) -> DataFrame:
    """Mentions as an end of any link, also of ids that name no node; nodes without links have 0."""
    ends = graph.links.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null").withColumn("n", F.lit(1))
    return ends.union(graph.node_ids().withColumn("n", F.lit(0))).groupBy("id").agg(F.sum("n").cast("long").alias("degree"))


def hub_threshold(graph: PropertyGraph, floor: int = 50) -> DataFrame:
    """One row ``hub_threshold``: the degree at place 99 n / 100 of all degrees in order, at least ``floor``."""
    return threshold_of(degree_directed(graph), floor)


def threshold_of(degrees: DataFrame, floor: int = 50) -> DataFrame:
    """:func:`hub_threshold` of known degrees, from their histogram, which has few rows however large the graph is."""
    histogram = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    upto = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("degree")))
    total = histogram.agg(F.sum("n").alias("total"))
    at = upto.crossJoin(F.broadcast(total)).where("upto > floor(total * 99 / 100)")  # total: one row
    return at.agg(F.greatest(F.coalesce(F.min("degree"), F.lit(floor)), F.lit(floor)).cast("long").alias("hub_threshold"))


def weighted_adjacency(graph: PropertyGraph) -> DataFrame:
    """``u, v, w`` in both directions, parallel links added up, a missing weight 1; a self-loop once with twice its weight."""
    w = F.coalesce("weight", F.lit(1.0))
    links = resolved_links(graph).select("source", "target", w.alias("w"))
    both = links.select(F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v")))).alias("e"), "w")
    return both.select("e.u", "e.v", "w").groupBy("u", "v").agg(F.sum("w").alias("w"))


def modularity(graph: PropertyGraph, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of the partition ``id, community``; 0 without links."""
    c = lambda end, name: communities.select(F.col("id").alias(end), F.col("community").alias(name))
    edges = weighted_adjacency(graph).join(c("u", "cu"), "u").join(c("v", "cv"), "v")
    per = edges.groupBy("cu").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("intra"))
    # sums of squares first: the whole weight is known only at the end
    sums = per.agg(F.sum("intra").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("t2"), F.sum("tot").alias("m2"))
    return sums.select(F.when(F.col("m2") > 0, F.col("i") / F.col("m2") - resolution * F.col("t2") / (F.col("m2") * F.col("m2"))).otherwise(0.0).alias("modularity"))


def cohesion(graph: PropertyGraph, communities: DataFrame) -> DataFrame:
    """``community, members, cohesion``: links inside over pairs of members; 1 for one member."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("members"))
    c = lambda end, name: communities.select(F.col("id").alias(end), F.col("community").alias(name))
    inside = resolved_links(graph).where("source <> target").join(c("source", "cs"), "source").join(c("target", "ct"), "target").where("cs = ct")
    inside = inside.groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("inside"))
    n = F.col("members")
    share = F.when(n <= 1, 1.0).otherwise(F.coalesce("inside", F.lit(0)) / (n * (n - 1) / 2))
    return sizes.join(inside, "community", "left").select("community", n.cast("long").alias("members"), share.cast("double").alias("cohesion"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def is_file_node(degree: Column) -> Column:
    """A file itself, a method, or a function that nothing is connected with."""
    label, source = _text("label"), _text("source_file")
    return (label != "") & (((source != "") & (basename(source) == label)) | (label.startswith(".") & label.endswith("()")) | (label.endswith("()") & (degree <= 1)))


def is_concept_node() -> Column:
    """No source file, or one without an extension."""
    return (_text("source_file") == "") | ~basename(_text("source_file")).contains(".")


def is_json_key() -> Column:
    return F.lower(_text("source_file")).endswith(".json") & F.lower(F.trim(_text("label"))).isin(JSON_KEYS)


def god_nodes(graph: PropertyGraph, top_n: int = 10) -> DataFrame:
    """``rank, id, label, degree``: the most connected real entities, ties in order of appearance."""
    ranked = graph.nodes.join(degree_undirected(graph), "id")
    ranked = ranked.where(~is_file_node(F.col("degree")) & ~is_concept_node() & ~is_json_key() & ~_text("label").isin(BUILTIN_NAMES))
    top = ranked.orderBy(F.desc("degree"), "ord").limit(top_n).select("id", "label", "degree", "ord")
    return top.select(F.row_number().over(Window.orderBy(F.desc("degree"), "ord")).cast("long").alias("rank"), "id", "label", "degree")


def surprising_connections(graph: PropertyGraph, communities: DataFrame, top_n: int = 5) -> DataFrame:
    """``rank, source, target, source_file, target_file, confidence, relation, score`` of the least expected links between files.

    A link speaks with the relation and confidence of the first link between its
    two nodes, whatever their direction; parallel links are listed each.
    """
    pair = [F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")]
    # links that are structural themselves may be the first between a pair, so all count here; no other column comes along
    first = graph.links.where("source is not null and target is not null").groupBy(*pair).agg(F.min_by(F.struct("relation", "confidence"), "ord").alias("f"))
    first = first.select("low", "high", F.coalesce("f.relation", F.lit("")).alias("relation"), F.coalesce("f.confidence", F.lit("EXTRACTED")).alias("confidence"))
    first = first.where(~F.col("relation").isin(*STRUCTURAL))
    info = graph.nodes.join(degree_undirected(graph), "id").join(communities.select("id", F.col("community").alias("c")), "id", "left")
    info = info.where(~is_concept_node() & ~is_file_node(F.col("degree")) & (_text("source_file") != ""))
    side = lambda end, p: info.select(F.col("id").alias(end), F.col("label").alias(f"{p}_label"), F.col("source_file").alias(f"{p}_file"), F.col("degree").alias(f"{p}_degree"), F.col("c").alias(f"{p}_c"))
    links = graph.links.select("ord", "source", "target", *pair).join(first, ["low", "high"]).join(side("source", "s"), "source").join(side("target", "t"), "target").where("s_file <> t_file")
    score = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    score = score + F.coalesce((F.col("s_c") != F.col("t_c")).cast("int"), F.lit(0))
    score = score + ((F.least("s_degree", "t_degree") <= 2) & (F.greatest("s_degree", "t_degree") >= 5)).cast("int")
    top = links.withColumn("score", score.cast("long")).orderBy(F.desc("score"), "ord").limit(top_n)
    name = lambda p, end: F.coalesce(F.col(f"{p}_label"), F.lit("")).alias(end)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "ord")).cast("long").alias("rank"), name("s", "source"), name("t", "target"), F.col("s_file").alias("source_file"), F.col("t_file").alias("target_file"), "confidence", "relation", "score")


def summary(graph: PropertyGraph) -> DataFrame:
    """One row ``files, nodes, links, extracted_pct, inferred_pct, ambiguous_pct``; any other confidence counts as extracted."""
    nodes = graph.nodes.agg(F.count_distinct(F.nullif("source_file", F.lit(""))).alias("files"), F.count("*").alias("nodes"))
    kind = lambda k: F.count_if(F.col("confidence") == k)
    links = graph.links.agg(F.count("*").alias("links"), F.coalesce(kind("INFERRED"), F.lit(0)).alias("i"), F.coalesce(kind("AMBIGUOUS"), F.lit(0)).alias("a"))
    pct = lambda n: F.round(n / F.greatest(F.col("links"), F.lit(1)) * 100).cast("long")
    both = nodes.crossJoin(links)  # one row each
    return both.select("files", "nodes", "links", pct(F.col("links") - F.col("i") - F.col("a")).alias("extracted_pct"), pct(F.col("i")).alias("inferred_pct"), pct(F.col("a")).alias("ambiguous_pct"))
