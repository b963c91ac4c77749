"""Resolution across files: stubs, module ids, imported names, uses of imported classes, calls of imported functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract.names import GLOBALS
from ..functions.text import basename, make_id, symbol_key
from ..tables import BEYOND, PropertyGraph, stored
from .dedupe import dedupe_links, dedupe_nodes, names_file, repoint, resolvable, stub_remap


def _stem(path):
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def module_remap(nodes: DataFrame) -> DataFrame:
    """Ids of bare modules that are no nodes -> the first file of that module."""
    label = F.coalesce(F.col("label"), F.lit(""))
    files = nodes.where(names_file(label) & (F.coalesce("source_file", F.lit("")) != ""))
    module = make_id(_stem(F.col("source_file")))
    first = files.select(module.alias("from_id"), "id", "ord").where("from_id <> ''").groupBy("from_id").agg(F.min_by("id", "ord").alias("to_id"))
    return first.where("from_id <> to_id").join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_anti")


def is_class(nodes: DataFrame):
    label = F.coalesce(F.col("label"), F.lit(""))
    return ~label.endswith("()") & ~names_file(label) & ~label.startswith(".") & (F.col("file_type") == "code")


def resolve_corpus(extraction) -> PropertyGraph:
    nodes, links = extraction.graph.nodes, extraction.graph.links
    remap = stub_remap(nodes)
    kept = nodes.join(remap.select(F.col("from_id").alias("id")), "id", "left_anti").select(*nodes.columns)
    both = stored(remap.unionByName(module_remap(kept)))
    nodes, links = stored(kept), stored(repoint(links, both))
    fresh = imported_links(nodes, links, extraction.imports, extraction.calls)
    return PropertyGraph(dedupe_nodes(nodes), dedupe_links(links.unionByName(fresh)), extraction.graph.meta)


def imported_links(nodes: DataFrame, links: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """New links that the imports of Python files justify; none that is there already.

    Joins are on (module, name) and on (file, name); names that more than one
    definition answers to resolve to nothing.
    """
    source = F.coalesce(F.col("source_file"), F.lit(""))
    own = nodes.where(resolvable(nodes) & source.endswith(".py"))
    defs = own.select(_stem(source).alias("module"), symbol_key(F.col("label")).alias("name"), "id")
    unique = defs.groupBy("module", "name").agg(F.min("id").alias("target"), F.max("id").alias("other")).where("target = other").drop("other")
    bound = imports.join(unique, ["module", "name"])
    root = nodes.where(names_file(F.col("label")) & (basename(source) == F.col("label"))).groupBy(source.alias("file")).agg(F.min_by("id", "ord").alias("root"))

    # 1. the file imports the definition
    a = bound.join(root, "file").select("ord", F.lit(1).alias("step"), F.col("root").alias("source"), "target", F.lit("imports").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit("import").alias("context"), "file", "line", F.lit(1.0).alias("weight"))

    # 2. each class of the file uses each imported class
    classes = own.where(is_class(own)).select(_stem(source).alias("module"), symbol_key(F.col("label")).alias("name"), "id", "ord")
    classes = classes.groupBy("module", "name").agg(F.max_by("id", "ord").alias("target"))
    local = nodes.where((F.coalesce("file_type", F.lit("")) != "rationale") & ~F.coalesce("label", F.lit("")).endswith("()") & ~names_file(F.col("label")) & (source != "")).select(source.alias("file"), F.col("id").alias("source"), F.col("ord").alias("local_ord"))
    b = imports.join(classes, ["module", "name"]).join(local, "file").where("source <> target")
    b = b.select(F.col("ord"), F.lit(2).alias("step"), "source", "target", F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(None).cast("string").alias("context"), "file", "line", F.lit(0.8).alias("weight"))

    # 3. functions call imported functions by the name that the import binds; the last binding counts
    alias = imports.groupBy("file", F.col("alias").alias("callee")).agg(F.max_by(F.struct("module", "name"), "ord").alias("last")).select("file", "callee", "last.module", "last.name")
    c = calls.where(~F.col("callee").isin(sorted(GLOBALS))).join(alias, ["file", "callee"]).join(unique, ["module", "name"])
    c = c.join(nodes.select(F.col("id").alias("caller")), "caller", "left_semi").where("caller <> target")
    c = c.select("ord", F.lit(3).alias("step"), F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit("call").alias("context"), "file", "line", F.lit(1.0).alias("weight"))

    new = a.unionByName(b).unionByName(c).join(links.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")
    # behind all links of the files: theirs stay below BEYOND, and there are three steps
    place = (F.lit(4 * BEYOND) + (F.col("step") - 1) * F.lit(BEYOND) + F.col("ord")).cast("long")
    return new.select(
        place.alias("ord"), "source", "target", "relation", "confidence", "context", F.col("file").alias("source_file"), F.concat(F.lit("L"), F.col("line")).alias("source_location"), "weight", F.lit(None).cast("string").alias("extra")
    ).select(*links.columns)
