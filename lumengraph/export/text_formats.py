"""GraphML and Cypher: a line of text for each row, ordered, written as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..tables import PropertyGraph


def _cypher_text(text: Column) -> Column:
    """Without control characters except the tab, backslashes and quotes escaped."""
    kept = F.regexp_replace(text, r"[\x00-\x08\x0A-\x1F]", "")
    return F.replace(F.replace(kept, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def _identifier(text: Column, fallback: str) -> Column:
    kept = F.regexp_replace(text, "[^A-Za-z0-9_]", "")
    return F.when(kept.rlike("^[A-Za-z]"), kept).otherwise(F.lit(fallback))


def cypher_nodes(graph: PropertyGraph) -> DataFrame:
    """``ord, line``: a MERGE for each node."""
    kind = F.coalesce(F.nullif("file_type", F.lit("")), F.lit("unknown"))
    kind = _identifier(F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 2**30))), "Entity")
    node_id = F.coalesce("id", F.lit(""))
    line = F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: '"), _cypher_text(node_id), F.lit("', label: '"), _cypher_text(F.coalesce("label", node_id)), F.lit("'});"))
    return graph.nodes.select("ord", line.alias("line"))


def cypher_links(graph: PropertyGraph) -> DataFrame:
    """``ord, line``: a MATCH and MERGE for each link."""
    relation = _identifier(F.upper(F.coalesce(F.nullif("relation", F.lit("")), F.lit("RELATES_TO"))), "RELATES_TO")
    end = lambda c: _cypher_text(F.coalesce(F.col(c), F.lit("")))
    line = F.concat(
        F.lit("MATCH (a {id: '"), end("source"), F.lit("'}), (b {id: '"), end("target"), F.lit("'}) MERGE (a)-[:"), relation,
        F.lit(" {confidence: '"), _cypher_text(F.coalesce("confidence", F.lit("EXTRACTED"))), F.lit("'}]->(b);"),
    )
    return graph.links.select("ord", line.alias("line"))


_GRAPHML_TYPES = {"string": "string", "int": "long", "bigint": "long", "double": "double", "boolean": "boolean"}


def graphml_keys(graph: PropertyGraph) -> list[tuple[str, str, str, str]]:
    """(key, scope, name, type) of the attributes that occur; only whether a column has a value is asked of the data."""
    keys = []
    for scope, df, skip in (("node", graph.nodes, ("id", "ord", "extra")), ("edge", graph.links, ("source", "target", "ord", "extra"))):
        names = [c for c in df.columns if c not in skip and not c.startswith("_")]
        used = df.select(*[F.max(F.col(c).isNotNull()).alias(c) for c in names]).first()
        keys += [(scope, c, _GRAPHML_TYPES.get(dict(df.dtypes)[c], "string")) for c in names if used and used[c]]
    return [(f"d{i}", *k) for i, k in enumerate(keys)]


def _data(df: DataFrame, keys: list[tuple[str, str, str, str]], scope: str) -> Column:
    lines = [
        F.when(F.col(name).isNotNull(), F.concat(F.lit(f'      <data key="{key}">'), xml_escape(F.col(name).cast("string")), F.lit("</data>\n"))).otherwise("")
        for key, where, name, _ in keys
        if where == scope
    ]
    return F.concat(*lines) if lines else F.lit("")


def graphml_body(graph: PropertyGraph) -> DataFrame:
    """``part, ord, line``: nodes, then links."""
    keys = graphml_keys(graph)
    nodes = F.concat(F.lit('    <node id="'), xml_escape(F.coalesce("id", F.lit(""))), F.lit('">\n'), _data(graph.nodes, keys, "node"), F.lit("    </node>"))
    links = F.concat(F.lit('    <edge source="'), xml_escape(F.coalesce("source", F.lit(""))), F.lit('" target="'), xml_escape(F.coalesce("target", F.lit(""))), F.lit('">\n'), _data(graph.links, keys, "edge"), F.lit("    </edge>"))
    return graph.nodes.select(F.lit(0).alias("part"), "ord", nodes.alias("line")).union(graph.links.select(F.lit(1), "ord", links))


def _in_order(df: DataFrame, *order: str) -> Iterator[str]:
    """The lines of a frame, one partition at a time on the driver."""
    return (r["line"] for r in df.orderBy(*order).toLocalIterator())


def graphml_lines(graph: PropertyGraph) -> Iterator[str]:
    """The document piece by piece, for a single file."""
    default = "directed" if graph.meta.get("directed") else "undirected"
    space = "http://graphml.graphdrawing.org/xmlns"
    yield "<?xml version='1.0' encoding='utf-8'?>"
    yield f'<graphml xmlns="{space}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="{space} {space}/1.0/graphml.xsd">'
    for k, scope, name, kind in graphml_keys(graph):
        yield f'  <key id="{k}" for="{scope}" attr.name="{name}" attr.type="{kind}"/>'
    yield f'  <graph edgedefault="{default}">'
    yield from _in_order(graphml_body(graph), "part", "ord")
    yield "  </graph>"
    yield "</graphml>"


def to_graphml(graph: PropertyGraph) -> str:
    """The whole document as a string, for graphs that the driver can hold."""
    return "\n".join(graphml_lines(graph)) + "\n"


def cypher_lines(graph: PropertyGraph) -> Iterator[str]:
    """The statements one by one, for a single file."""
    yield from ("// Cypher import", "")
    yield from _in_order(cypher_nodes(graph), "ord")
    yield ""
    yield from _in_order(cypher_links(graph), "ord")


def to_cypher(graph: PropertyGraph) -> str:
    return "\n".join(cypher_lines(graph))


def save_cypher(graph: PropertyGraph, path: str) -> None:
    """The statements as a folder of text files in order, written by the executors."""
    lines = cypher_nodes(graph).select(F.lit(0).alias("part"), "ord", "line").union(cypher_links(graph).select(F.lit(1), "ord", "line"))
    lines.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.text(path)
