"""Command line: validate, lint, roundtrip, extract, cluster-only, export, query, path, explain, serve."""

from __future__ import annotations

import argparse
import contextlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import serve as rpc
from .export import pictures, text_formats
from .operators import cluster, integrity, report, traverse
from .sources import files, graph_json
from .tables import PropertyGraph, stored

GRAPH, REPORT, PAGE = "graph-out/graph.json", "GRAPH_REPORT.md", "graph.html"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumengraph")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("validate", "lint"):
        verbs.add_parser(verb).add_argument("graph")
    v = verbs.add_parser("roundtrip")
    v.add_argument("graph")
    v.add_argument("--pretty", action="store_true")
    v = verbs.add_parser("extract")
    v.add_argument("folder")
    v.add_argument("--no-cluster", action="store_true")
    v.add_argument("--out", default="graph-out")
    verbs.add_parser("cluster-only").add_argument("folder", nargs="?", default=".")
    v = verbs.add_parser("export")
    v.add_argument("format", choices=("html", "svg", "graphml", "cypher"))
    v.add_argument("--out")
    q = verbs.add_parser("query")
    q.add_argument("question")
    q.add_argument("--budget", type=int, default=traverse.BUDGET)
    q.add_argument("--dfs", action="store_true")
    w = verbs.add_parser("path")
    w.add_argument("a")
    w.add_argument("b")
    x = verbs.add_parser("explain")
    x.add_argument("node")
    for s in (v, q, w, x, verbs.add_parser("serve")):
        s.add_argument("--graph", default=GRAPH)
    return p


def _stamped(graph: PropertyGraph, found) -> PropertyGraph:
    nodes = graph.nodes.drop("community").join(found, "id", "left").withColumn("community", F.coalesce("community", F.lit(0)))
    return PropertyGraph(stored(nodes), graph.links, graph.meta)


def _write(graph: PropertyGraph, folder: Path, root: str, clustered: bool) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    if clustered:
        found = stored(cluster.communities(graph))
        graph = _stamped(graph, found)
        (folder / REPORT).write_text(report.render_report(graph, found, root), encoding="utf-8")
        (folder / PAGE).write_text(pictures.to_html(graph), encoding="utf-8")
    graph_json.write_graph(graph, str(folder / "graph.json"), pretty=True)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: problems found or nothing there; 2: usage."""
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumengraph").getOrCreate()
    path = getattr(args, "graph", None)
    if args.verb == "extract":
        built = files.build(spark, args.folder)
        graph = PropertyGraph(stored(built.nodes), stored(built.links), built.meta)
        _write(graph, Path(args.out), args.folder, not args.no_cluster)
        print(f"{graph.nodes.count()} nodes, {graph.links.count()} edges")
        return 0
    if args.verb == "cluster-only":
        folder = Path(args.folder) / "graph-out"
        _write(graph_json.read_graph(spark, str(folder / "graph.json")), folder, args.folder, True)
        return 0
    if not Path(path).exists():
        print(f"no graph at {path}", file=sys.stderr)
        return 1
    graph = graph_json.read_graph(spark, path)
    graph = PropertyGraph(stored(graph.nodes), stored(graph.links), graph.meta)
    if args.verb in ("validate", "lint"):
        rows = (integrity.validation_errors if args.verb == "validate" else integrity.dangling_links)(graph).orderBy("ord").collect()
        for r in rows:
            print(" ".join(map(str, r)))
        return int(bool(rows))
    if args.verb == "roundtrip":
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".json") as f:
            graph_json.write_graph(graph, f.name, args.pretty)
            print(Path(f.name).read_text(encoding="utf-8") if args.pretty else "ok")
    elif args.verb == "export":
        whole = lambda draw: lambda g: iter(draw(g).split("\n"))  # noqa: E731  pictures are bounded
        lines = {"html": whole(pictures.to_html), "svg": whole(pictures.to_svg), "graphml": text_formats.graphml_lines, "cypher": text_formats.cypher_lines}[args.format](graph)
        with open(args.out, "w", encoding="utf-8") if args.out else contextlib.nullcontext(sys.stdout) as out:
            out.writelines(f"{line}\n" for line in lines)
    elif args.verb == "query":
        print(rpc.call_tool(graph, "query_graph", {"question": args.question, "token_budget": args.budget, "mode": "dfs" if args.dfs else "bfs"}))
    elif args.verb == "path":
        try:
            hops = traverse.path(graph, args.a, args.b)
        except LookupError as e:
            print(e, file=sys.stderr)
            return 1
        if hops.isEmpty():
            print("No path found.")
            return 1
        print(traverse.render_path(graph, hops))
    elif args.verb == "explain":
        about = traverse.explain(graph, args.node)
        print(about.render() if about else f"No node matching '{args.node}' found.")
        return int(about is None)
    else:
        rpc.serve(graph)
    return 0


if __name__ == "__main__":
    sys.exit(main())
