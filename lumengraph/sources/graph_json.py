"""Node-link JSON documents and Parquet tables of a property graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import LINK_COLUMNS, LINK_SCHEMA, NODE_COLUMNS, NODE_SCHEMA, PropertyGraph

_DOC = "directed boolean, multigraph boolean, graph string, nodes array<string>, links array<string>, edges array<string>"


def _typed(items: DataFrame, schema: str) -> DataFrame:
    """Known keys as columns where their JSON type fits, the rest of each object as JSON in ``extra``."""
    known = [c.split() for c in schema.split(", ")][1:-1]
    raw = F.from_json("item", "map<string,string>")
    rows = items.withColumn("_raw", raw).withColumn("_typed", F.from_json("item", ", ".join(f"`{n}` {t}" for n, t in known)))
    # a known key whose value has another type stays in extra
    names = [n for n, _ in known]
    beyond = F.map_filter("_raw", lambda k, v: ~k.isin(names))
    extra = F.when(F.size(beyond) > 0, F.col("item"))
    return rows.select(F.col("pos").cast("long").alias("ord"), *[F.col(f"_typed.{n}").alias(n) for n in names], extra.alias("extra"))


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A node-link document; links may be called edges, missing keys have defaults, the place in the list is ``ord``.

    ``extra`` holds the whole object where it has keys beyond the schema, so that nothing is lost.
    """
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", _DOC).alias("d"), "value")
    items = lambda *names: doc.select(F.posexplode(F.coalesce(*[F.col(f"d.{n}") for n in names])).alias("pos", "item"))
    head = doc.select("value").first()["value"]
    top = json.loads(head)
    meta = {k: v for k, v in top.items() if k not in ("nodes", "links", "edges")}
    return PropertyGraph(_typed(items("nodes"), NODE_SCHEMA), _typed(items("links", "edges"), LINK_SCHEMA), meta)


def _objects(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object for each row: the original one with the known keys brought up to date, or the known keys that are set."""
    own = F.to_json(F.struct(*[F.col(c) for c in columns if c not in ("ord", "extra")]))
    return df.select("ord", own.alias("own"), "extra")


def write_graph(graph: PropertyGraph, path: str, pretty: bool = False) -> None:
    """One node-link document.  A single file is written by the driver, row by row in order."""
    shaped = graph.shaped()
    meta = {"directed": False, "multigraph": False, "graph": {}} | graph.meta

    def rows(df: DataFrame, columns: list[str]):
        for r in _objects(df, columns).orderBy("ord").toLocalIterator():
            own = json.loads(r["own"])
            yield (json.loads(r["extra"]) | own) if r["extra"] else own

    line = lambda depth: "\n" + "  " * depth if pretty else ""
    shown = lambda x, depth: json.dumps(x, ensure_ascii=False, indent=2 if pretty else None).replace("\n", line(depth))
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for k, v in meta.items():
            f.write(f"{line(1)}{json.dumps(k)}: {shown(v, 1)},")
        # lists are written as they come, one partition at a time
        for key, found in (("nodes", rows(shaped.nodes, NODE_COLUMNS)), ("links", rows(shaped.links, LINK_COLUMNS))):
            f.write(f'{line(1)}"{key}": [')
            for i, row in enumerate(found):
                f.write(("," if i else "") + line(2) + shown(row, 2))
            f.write(line(1) + ("]," if key == "nodes" else "]"))
        f.write(line(0) + "}")


def save_tables(graph: PropertyGraph, path: str) -> None:
    shaped = graph.shaped()
    shaped.nodes.write.parquet(f"{path}/nodes")
    shaped.links.write.parquet(f"{path}/links")


def load_tables(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/links"))
