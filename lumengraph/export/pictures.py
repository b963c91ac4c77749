"""SVG and HTML pictures of graphs small enough to look at; rows are prepared in Spark, drawn on the driver."""

from __future__ import annotations

import json
from html import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import degree_export
from ..tables import PropertyGraph

#: Colours of communities, in turn.
COLORS = ("#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC")
WIDTH, HEIGHT, MARGIN = 1600.0, 1200.0, 60.0
#: Nodes up to which a picture is drawn; the layout compares all pairs.
MOST_NODES = 5000


def drawn_nodes(graph: PropertyGraph) -> DataFrame:
    """``ord, id, label, community, community_name, source_file, file_type, degree, size, color``; sizes 10 to 40 by degree."""
    nodes = graph.shaped().nodes.join(degree_export(graph), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = degree_export(graph).agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    community = F.coalesce("community", F.lit(0))
    return nodes.crossJoin(F.broadcast(top)).select(  # top: one row
        "ord", "id", F.coalesce("label", "id").alias("label"), community.alias("community"), F.coalesce("community_name", F.concat(F.lit("Community "), community)).alias("community_name"),
        F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("file_type", F.lit("")).alias("file_type"), "degree",
        F.round(10 + 30 * F.col("degree") / F.col("top"), 1).alias("size"), F.get(F.array(*map(F.lit, COLORS)), F.pmod(community, F.lit(len(COLORS)))).alias("color"),
    )


def spring_layout(n: int, pairs: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Places of n nodes by springs along links and repulsion of all others; the same each time."""
    if not n:
        return np.zeros((0, 2))
    turn, k = 2 * np.pi * np.arange(n) / n, np.sqrt(WIDTH * HEIGHT / n)
    place = np.stack([WIDTH / 2 + 0.35 * HEIGHT * np.cos(turn) + np.arange(n) % 7 * 0.5, HEIGHT / 2 + 0.35 * HEIGHT * np.sin(turn) + np.arange(n) % 5 * 0.5], axis=1)
    for heat in np.linspace(WIDTH * 0.1, 0, rounds + 1, endpoint=False)[:rounds]:
        push = np.zeros((n, 2))
        for at in range(0, n, 512):  # blocks bound the pairwise arrays
            gap = place[at : at + 512, None] - place[None]
            push[at : at + 512] = (gap * (k * k / np.maximum((gap**2).sum(-1), 1e-4))[..., None]).sum(1)
        if len(pairs):
            gap = place[pairs[:, 0]] - place[pairs[:, 1]]
            pull = gap * (np.sqrt((gap**2).sum(-1)) / k)[:, None]
            np.add.at(push, pairs[:, 0], -pull)
            np.add.at(push, pairs[:, 1], pull)
        far = np.maximum(np.sqrt((push**2).sum(-1)), 0.01)[:, None]
        place += push / far * np.minimum(far, heat)
    low, high = place.min(0), place.max(0)
    return MARGIN + (place - low) * ((np.array([WIDTH, HEIGHT]) - 2 * MARGIN) / np.maximum(high - low, 1e-6))


def _rows(graph: PropertyGraph) -> tuple[list, list]:
    if graph.nodes.count() > MOST_NODES:
        raise ValueError(f"pictures hold at most {MOST_NODES} nodes; take a part of the graph")
    nodes = drawn_nodes(graph).orderBy("ord").collect()
    ids = {r["id"] for r in nodes}
    links = [r for r in graph.shaped().links.select("ord", "source", "target", "relation", "confidence").orderBy("ord").collect() if r["source"] in ids and r["target"] in ids]
    return nodes, links


def to_svg(graph: PropertyGraph) -> str:
    nodes, links = _rows(graph)
    at = {r["id"]: i for i, r in enumerate(nodes)}
    pairs = np.array([(at[x["source"]], at[x["target"]]) for x in links if x["source"] != x["target"]], dtype=int).reshape(-1, 2)
    place = spring_layout(len(nodes), pairs)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH:.0f} {HEIGHT:.0f}">']
    for a, b in pairs:
        out.append('<line x1="{:.1f}" y1="{:.1f}" x2="{:.1f}" y2="{:.1f}" stroke="#999" stroke-opacity="0.4"/>'.format(*place[a], *place[b]))
    for r, (x, y) in zip(nodes, place):
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{r["size"] / 3:.1f}" fill="{r["color"]}"><title>{escape(r["label"] or "")}</title></circle>')
        out.append(f'<text x="{x:.1f}" y="{y - r["size"] / 3 - 2:.1f}" font-size="9" text-anchor="middle">{escape(r["label"] or "")}</text>')
    return "\n".join([*out, "</svg>"])


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title><style>body{margin:0;font:13px sans-serif}#q{position:fixed;top:8px;left:8px;padding:4px}#about{position:fixed;top:8px;right:8px;width:260px;background:#fffc}</style></head>
<body><input id="q" placeholder="search"><div id="about"></div><canvas id="c"></canvas><script>
const nodes = NODES, links = LINKS, byId = Object.fromEntries(nodes.map(n => [n.id, n]));
const canvas = document.getElementById("c"), g = canvas.getContext("2d");
function draw(mark) {
  canvas.width = innerWidth; canvas.height = innerHeight;
  const sx = innerWidth / 1600, sy = innerHeight / 1200;
  g.strokeStyle = "#9996";
  for (const l of links) { const a = byId[l.source], b = byId[l.target]; g.beginPath(); g.moveTo(a.x * sx, a.y * sy); g.lineTo(b.x * sx, b.y * sy); g.stroke(); }
  for (const n of nodes) { g.globalAlpha = !mark || n.label.toLowerCase().includes(mark) ? 1 : 0.15; g.fillStyle = n.color; g.beginPath(); g.arc(n.x * sx, n.y * sy, n.size / 3, 0, 7); g.fill(); g.fillText(n.label, n.x * sx + n.size / 3, n.y * sy); }
}
document.getElementById("q").oninput = e => draw(e.target.value.toLowerCase());
canvas.onclick = e => { const d = n => Math.hypot(n.x * innerWidth / 1600 - e.x, n.y * innerHeight / 1200 - e.y); const n = nodes.reduce((a, b) => d(a) < d(b) ? a : b); document.getElementById("about").textContent = n.label + " - " + n.community_name + " - " + n.source_file + " - " + n.degree + " links"; };
onresize = () => draw(); draw();
</script></body></html>"""


def to_html(graph: PropertyGraph) -> str:
    """A page that needs nothing from elsewhere."""
    nodes, links = _rows(graph)
    at = {r["id"]: i for i, r in enumerate(nodes)}
    pairs = np.array([(at[x["source"]], at[x["target"]]) for x in links if x["source"] != x["target"]], dtype=int).reshape(-1, 2)
    place = spring_layout(len(nodes), pairs)
    shown = [r.asDict() | {"x": round(float(x), 1), "y": round(float(y), 1)} for r, (x, y) in zip(nodes, place)]
    safe = lambda x: json.dumps(x, ensure_ascii=False).replace("</", "<\\/")
    return _PAGE.replace("NODES", safe(shown), 1).replace("LINKS", safe([x.asDict() for x in links]), 1)
