"""Folders of source files and documents as graphs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.emitter import Emitter
from ..operators.dedupe import dedupe_links, dedupe_nodes
from ..tables import PER_FILE, PropertyGraph, stored

#: Endings that the scan of a folder takes by default, and folders that it leaves out.
WALKED = "py pyi js jsx mjs cjs ts mts cts java c h cpp cc cxx hpp hh hxx go rs".split()
SKIPPED = ("target", "node_modules")

_ROW = "file string, kind string, idx long, a string, b string, c string, d string, e string, f string, g string, w double, line long, extra string"
_NODE = ("id", "label", "file_type", "source_file", "source_location")
_LINK = ("source", "target", "relation", "confidence", "context", "source_file", "source_location")


def scan(spark: SparkSession, root: str, endings: list[str] | None = None) -> DataFrame:
    """``file, content`` of the files below ``root`` with one of the endings; hidden folders and SKIPPED are left out."""
    # paths of files begin with the full name of the folder
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    inside = F.substring("path", len(base) + 2, 2**30)
    names = F.split(inside, "/")
    folders = F.slice(names, 1, F.size(names) - 1)
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    ending = F.lower(F.element_at(F.split(inside, r"\."), -1))
    return files.select(inside.alias("file"), "content").where(~hidden & ending.isin(endings or WALKED))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from ..extract.dispatch import extract

    yield from rows_of(extract)(batches)


def rows_of(read: Callable[[str, bytes], Emitter]) -> Callable:
    """Tagged rows of what ``read`` gives for each ``file, content``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _batch(b, read)

    return scan


def _batch(b: pd.DataFrame, read: Callable[[str, bytes], Emitter]) -> pd.DataFrame:
    names = [c.split()[0] for c in _ROW.split(", ")]
    out = []
    for file, content in zip(b["file"], b["content"]):
        e = read(file, bytes(content))
        for i, n in enumerate(e.nodes):
            extra = {k: v for k, v in n.items() if k not in _NODE}
            out.append((file, "node", i, *[n[k] for k in _NODE], None, None, None, None, json.dumps(extra) if extra else None))
        for i, x in enumerate(e.links):
            extra = {k: v for k, v in x.items() if k not in _LINK and k != "weight"}
            out.append((file, "link", i, *[x[k] for k in _LINK], x["weight"], None, json.dumps(extra) if extra else None))
        for i, (needs, x) in enumerate(e.conditional, len(e.links)):
            out.append((file, "maybe", i, *[x[k] for k in _LINK], x["weight"], None, needs))
        for i, choice in enumerate(e.choices):
            out.append((file, "choice", i, *choice, None, None, None, None, None, None, None))
        for i, x in enumerate(e.imports):
            out.append((file, "import", i, x["module"], x["name"], x["alias"], None, None, None, None, None, x["line"], None))
        for i, x in enumerate(e.calls):
            out.append((file, "call", i, x["caller"], x["callee"], None, None, None, None, None, None, x["line"], None))
    return pd.DataFrame(out, columns=names)


@dataclass
class Extraction:
    """A graph and what the resolution across files needs of its Python files."""

    graph: PropertyGraph
    imports: DataFrame
    calls: DataFrame


def _chosen(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links with what the folder says of them: workers don't look for files, they name those that a target may mean.

    A target stands for the first of its files that is there; links that need a file go without it.
    """
    there = rows.select(F.col("file").alias("path")).distinct()
    choices = rows.where("kind = 'choice'").select("file", F.col("a").alias("target"), F.col("b").alias("path"), F.col("c").alias("found"), "idx")
    chosen = choices.join(there, "path").groupBy("file", "target").agg(F.min_by("found", "idx").alias("found"))
    links = rows.where("kind = 'link'").withColumn("target", F.col("b")).join(chosen, ["file", "target"], "left")
    links = links.withColumn("b", F.coalesce("found", "target")).select(*rows.columns)
    needed = rows.where("kind = 'maybe'").join(there, F.col("extra") == F.col("path"), "left_semi").withColumn("extra", F.lit(None).cast("string"))
    # nodes that stood for a target give way to what it is
    nodes = rows.where("kind = 'node'").join(chosen.select("file", F.col("target").alias("a")), ["file", "a"], "left_anti").select(*rows.columns)
    return nodes, links.unionByName(needed)


def file_ranks(rows: DataFrame) -> DataFrame:
    """``file, rank``: the place of each file in order of path, without gaps, from the sizes of sorted partitions."""
    spark = rows.sparkSession
    ordered = rows.select("file").distinct().repartitionByRange("file").sortWithinPartitions("file")
    # the id of a row is its partition, then its place there
    placed = stored(ordered.select("file", F.monotonically_increasing_id().alias("id")))
    part = F.shiftright("id", 33)
    before, bases = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        bases.append((r["part"], before))
        before += r["count"]
    bases = spark.createDataFrame(bases, "part long, base long")
    return placed.withColumn("part", part).join(F.broadcast(bases), "part").select("file", (F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def extract_files(files: DataFrame) -> Extraction:
    """Nodes and links of ``file, content`` rows.  Each file is read and parsed once; ``ord`` follows the files' paths."""
    return graph_of(files.mapInPandas(_rows, _ROW))


def graph_of(rows: DataFrame) -> Extraction:
    """The graph of tagged rows."""
    rows = stored(rows)
    # rows of a file keep the order of their emission
    rows = rows.join(file_ranks(rows), "file").withColumn("ord", F.col("rank") * PER_FILE + F.col("idx"))
    own_nodes, own_links = _chosen(rows)
    of = lambda kind, names: {"node": own_nodes, "link": own_links}.get(kind, rows).where(F.col("kind").isin(kind, "maybe") if kind == "link" else F.col("kind") == kind).select("ord", "file", *[F.col(c).alias(n) for c, n in zip("abcdefg", names)], F.col("w").alias("weight"), "line", "extra")
    nodes = of("node", _NODE).drop("weight", "line", "file")
    links = of("link", _LINK).drop("line", "file")
    imports = of("import", ("module", "name", "alias")).select("ord", "file", "module", "name", "alias", "line")
    calls = of("call", ("caller", "callee")).select("ord", "file", "caller", "callee", "line")
    return Extraction(PropertyGraph(dedupe_nodes(nodes), dedupe_links(links)), imports, calls)


def build(spark: SparkSession, root: str, endings: list[str] | None = None) -> PropertyGraph:
    """The resolved graph of a folder."""
    from ..operators.resolve import resolve_corpus

    return resolve_corpus(extract_files(scan(spark, root, endings)))
