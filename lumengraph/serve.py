"""Tools over a graph as JSON-RPC on lines of text."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable

from .operators import traverse
from .tables import PropertyGraph

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
#: name -> (description, properties, required)
TOOLS = {
    "query_graph": ("The part of the graph that a question is about.", {"question": _TEXT, "mode": {"type": "string", "enum": ["bfs", "dfs"]}, "token_budget": _NUMBER}, ["question"]),
    "get_node": ("Everything about a node by label or id.", {"label": _TEXT}, ["label"]),
    "get_neighbors": ("The direct neighbours of a node.", {"label": _TEXT, "relation_filter": _TEXT}, ["label"]),
    "shortest_path": ("The shortest path between two nodes.", {"source": _TEXT, "target": _TEXT}, ["source", "target"]),
}


def call_tool(graph: PropertyGraph, name: str, args: dict) -> str:
    if name == "query_graph":
        found = traverse.query(graph, args["question"], int(args.get("token_budget", traverse.BUDGET)), args.get("mode") == "dfs")
        lines = [f"mode={found['mode']} seeds={', '.join(found['seeds'])}", *(f"NODE {n}" for n in found["nodes"]), *(f"EDGE {a} -- {b}" for a, b in found["edges"])]
        return "\n".join(lines) if found["nodes"] else "No matching nodes found."
    if name == "get_node":
        about = traverse.explain(graph, args["label"])
        return about.render() if about else f"No node matching '{args['label']}' found."
    if name == "get_neighbors":
        node = traverse.find_node(graph, args["label"])
        if node is None:
            return f"No node matching '{args['label']}' found."
        rows = traverse.neighbors(graph, node, args.get("relation_filter") or "").collect()
        return "\n".join([f"Neighbors of {node}:", *(f"  {'-->' if r['direction'] == 'out' else '<--'} {r['neighbor']} [{r['relation']}] [{r['confidence']}]" for r in rows)])
    if name == "shortest_path":
        try:
            hops = traverse.path(graph, args["source"], args["target"])
        except LookupError as e:
            return str(e)
        return traverse.render_path(graph, hops) if not hops.isEmpty() else "No path found."
    raise LookupError(f"Unknown tool: {name}")


def handle(graph: PropertyGraph, request: dict) -> dict | None:
    """The reply to one request; None for notifications."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lumengraph", "version": "0.1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        listed = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]
        return reply | {"result": {"tools": listed}}
    if method == "tools/call":
        try:
            text, failed = call_tool(graph, params.get("name", ""), params.get("arguments") or {}), False
        except (LookupError, ValueError) as e:
            text, failed = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def serve(graph: PropertyGraph, lines: Iterable[str] = sys.stdin, out=sys.stdout) -> None:
    for line in filter(str.strip, lines):
        try:
            reply = handle(graph, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
