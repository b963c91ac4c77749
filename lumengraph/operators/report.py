"""The Markdown report of a graph, built on the driver from a few small frames."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import PropertyGraph
from .metrics import cohesion, degree_undirected, god_nodes, is_file_node, summary, surprising_connections

SHOWN = 8


def community_members(graph: PropertyGraph, communities: DataFrame, shown: int = SHOWN) -> DataFrame:
    """``community, total, names``: the first labels (by id) of the members that are no file nodes, of all members where none is left."""
    rows = graph.nodes.drop("community").join(degree_undirected(graph), "id").join(communities, "id")
    rows = rows.select("community", "id", F.coalesce("label", F.lit("")).alias("label"), (~is_file_node(F.col("degree"))).alias("real"))
    totals = rows.groupBy("community").agg(F.count("*").alias("all"), F.count_if("real").alias("real_ones"))
    # a limit on the rank is applied before rows are shuffled, too: no task holds a whole community
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("real"), "id"))
    first = rows.withColumn("place", place).where(F.col("place") <= shown)
    first = first.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("place", "label", "real"))).alias("first"))
    some = F.col("real_ones") > 0
    names = F.transform(F.filter("first", lambda x: x["real"] | ~some), lambda x: x["label"])
    return totals.join(first, "community").select("community", F.when(some, F.col("real_ones")).otherwise(F.col("all")).alias("total"), names.alias("names"))


def render_report(graph: PropertyGraph, communities: DataFrame, root: str, today: str | None = None) -> str:
    s = summary(graph).first()
    gods = god_nodes(graph, 10).orderBy("rank").collect()
    surprises = surprising_connections(graph, communities, 5).orderBy("rank").collect()
    tight = {r["community"]: r["cohesion"] for r in cohesion(graph, communities).collect()}
    groups = sorted(community_members(graph, communities).collect(), key=lambda r: r["community"])
    today = today or dt.datetime.now(dt.timezone.utc).date().isoformat()
    out = [f"# Graph Report - {root}  ({today})", "", "## Corpus Check", f"- {s['files']} files", "- Verdict: corpus is large enough that graph structure adds value."]
    out += ["", "## Summary", f"- {s['nodes']} nodes · {s['links']} edges · {len(groups)} communities detected"]
    out += [f"- Extraction: {s['extracted_pct']}% EXTRACTED · {s['inferred_pct']}% INFERRED · {s['ambiguous_pct']}% AMBIGUOUS"]
    out += ["", "## God Nodes (most connected - your core abstractions)"] + [f"{g['rank']}. `{g['label']}` - {g['degree']} edges" for g in gods]
    out += ["", "## Surprising Connections (you probably didn't know these)"]
    for x in surprises:
        out += [f"- `{x['source']}` --{x['relation']}--> `{x['target']}`  [{x['confidence']}]", f"  {x['source_file']} → {x['target_file']}"]
    if not surprises:
        out.append("- None detected - all connections are within the same source files.")
    out += ["", "## Communities"]
    for g in groups:
        c = g["community"]
        more = f" (+{g['total'] - SHOWN} more)" if g["total"] > SHOWN else ""
        share = Decimal(tight[c]).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        out += ["", f'### Community {c} - "Community {c}"', f"Cohesion: {share}", f"Nodes ({g['total']}): {', '.join(g['names'])}{more}"]
    return "\n".join(out)
