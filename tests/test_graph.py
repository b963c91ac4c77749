import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lumengraph import serve
from lumengraph.export import pictures, text_formats
from lumengraph.operators import cluster, dedupe, integrity, metrics, traverse
from lumengraph.sources import graph_json
from lumengraph.tables import PropertyGraph

NODES = "ord long, id string, label string, file_type string, source_file string, community int"
LINKS = "ord long, source string, target string, relation string, confidence string, weight double"


def graph(spark, nodes, links):
    return PropertyGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS))


def random_graph(spark, seed, n=40, m=70):
    rng = random.Random(seed)
    nodes = [(i, f"n{i}", f"Node {i}", "code", f"f{i % 4}.py", i % 5) for i in range(n)]
    links = [(k, f"n{rng.randrange(n)}", f"n{rng.randrange(n + 2)}", rng.choice(["calls", "uses"]), "EXTRACTED", 1.0) for k in range(m)]
    return graph(spark, nodes, links), n, links


def adjacency(n, links):
    near = {i: set() for i in range(n)}
    for _, s, t, *_ in links:
        a, b = int(s[1:]), int(t[1:])
        if a < n and b < n:
            near[a].add(b)
            near[b].add(a)
    return near


@pytest.mark.parametrize("seed", [1, 2])
def test_expansion_follows_a_queue(spark, seed):
    g, n, links = random_graph(spark, seed)
    near, seeds, budget = adjacency(n, links), [3, 7], 17
    order, layer = list(seeds), list(seeds)
    for _ in range(2):
        fresh = []
        for x in layer:
            for y in sorted(near[x]):
                if y not in order and len(order) < budget:
                    order.append(y)
                    fresh.append(y)
        layer = fresh
    got = [r["id"] for r in traverse.expand(g, ["n3", "n7"], budget).orderBy("rank").collect()]
    assert got == [f"n{x}" for x in order]


def test_shortest_path_is_the_first_of_a_queue(spark):
    g, n, links = random_graph(spark, 5)
    near, parent, queue = adjacency(n, links), {0: None}, deque([0])
    while queue:
        x = queue.popleft()
        for y in sorted(near[x]):
            if y not in parent:
                parent[y] = x
                queue.append(y)
    target = next(x for x in reversed(list(parent)) if x)
    want = []
    x = target
    while x:
        want.append((f"n{parent[x]}", f"n{x}"))
        x = parent[x]
    got = [(r["from_id"], r["to_id"]) for r in traverse.shortest_path(g, "n0", f"n{target}").orderBy("hop").collect()]
    assert got == want[::-1]
    alone = next((x for x in range(n) if x not in parent), None)
    if alone is not None:
        assert traverse.shortest_path(g, "n0", f"n{alone}").count() == 0


def test_dedupe_keeps_last_attributes_and_first_links(spark):
    g = graph(spark, [(1, "a", "old", "code", "x.py", 1), (2, "b", "b", "code", "x.py", 1), (3, "a", "new", "code", "y.py", None), (4, None, "?", "code", "", 0)], [(1, "a", "b", "calls", "EXTRACTED", 1.0), (2, "a", "b", "calls", "INFERRED", 2.0), (3, None, "b", None, None, 1.0)])
    nodes = {r["id"]: (r["ord"], r["label"], r["community"]) for r in dedupe.dedupe_nodes(g.nodes).collect()}
    assert nodes == {"a": (1, "new", None), "b": (2, "b", 1)}
    assert sorted((r["ord"], r["confidence"]) for r in dedupe.dedupe_links(g.links).collect()) == [(1, "EXTRACTED"), (3, None)]
    kinds = sorted((r["kind"], r["ord"]) for r in integrity.validation_errors(g).collect())
    assert kinds == [("duplicate id", 3), ("missing id", 4), ("missing key", 3), ("missing key", 3)]


def test_three_degrees_of_a_loop(spark):
    g = graph(spark, [(1, "a", "a", "code", "x.py", 1), (2, "b", "b", "code", "x.py", 1)], [(1, "a", "a", "r", None, 1.0), (2, "a", "b", "r", None, 1.0), (3, "b", "ghost", "r", None, 1.0)])
    as_dict = lambda df: {r["id"]: r["degree"] for r in df.collect()}
    assert as_dict(metrics.degree_undirected(g)) == {"a": 2, "b": 1}
    assert as_dict(metrics.degree_directed(g)) == {"a": 3, "b": 1}
    assert as_dict(metrics.degree_export(g)) == {"a": 3, "b": 2, "ghost": 1}


def test_communities_of_two_cliques(spark):
    nodes = [(i, f"n{i}", f"n{i}", "code", "x.py", 0) for i in range(10)]
    links = [(i * 10 + j, f"n{a + i}", f"n{a + j}", "r", None, 1.0) for a in (0, 5) for i in range(5) for j in range(i)] + [(999, "n0", "n5", "r", None, 1.0)]
    g = graph(spark, nodes, links)
    found = {r["id"]: r["community"] for r in cluster.communities(g).collect()}
    assert found == {f"n{i}": i // 5 for i in range(10)}
    # the synchronous mode gives another partition, of every node and of like quality
    loose = cluster.communities(g, mode="synchronous")
    assert loose.count() == 10
    assert metrics.modularity(g, loose).first()["modularity"] >= 0.2


def test_node_link_documents_keep_everything(spark, tmp_path):
    doc = {"directed": True, "graph": {"k": [1]}, "nodes": [{"id": "a", "label": "A", "array": [1, {"x": None}], "community": 3}, {"id": "b"}], "edges": [{"source": "a", "target": "b", "relation": "r", "weight": 0.5, "own": 1.0}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = graph_json.read_graph(spark, str(tmp_path / "g.json"))
    graph_json.write_graph(g, str(tmp_path / "out.json"))
    back = json.loads((tmp_path / "out.json").read_text())
    assert back["nodes"] == doc["nodes"] and back["links"] == doc["edges"] and back["directed"] is True and back["graph"] == {"k": [1]}


def test_exports_escape(spark):
    g = graph(spark, [(1, "a'\\\n", 'x<&">', "code", "x.py", 1), (2, "b", "b", None, "x.py", None)], [(1, "a'\\\n", "b", "calls it", None, 1.0)])
    cypher = text_formats.to_cypher(g)
    assert "MERGE (n:Code {id: 'a\\'\\\\', label: 'x<&\">'});" in cypher and "[:CALLSIT {confidence: 'EXTRACTED'}]" in cypher and "(n:Unknown" in cypher
    graphml = text_formats.to_graphml(g)
    import xml.etree.ElementTree as ET

    root = ET.fromstring(graphml.encode())
    assert len([e for e in root.iter() if e.tag.endswith("}node")]) == 2
    assert "x&lt;&amp;&quot;&gt;" in graphml
    assert pictures.to_svg(g).count("<circle") == 2
    page = pictures.to_html(g)
    assert "</script>" == page[page.rindex("</script>") :][:9] and "http" not in page.replace("http-equiv", "")


def test_tools_over_json_rpc(spark):
    g = graph(spark, [(1, "mod_client", "Client", "code", "m.py", 1), (2, "mod_send", ".send()", "code", "m.py", 1), (3, "far", "Far", "code", "n.py", 2)], [(1, "mod_client", "mod_send", "method", "EXTRACTED", 1.0)])
    call = lambda name, **a: serve.handle(g, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert "mod_send" in call("query_graph", question="what is the client")["content"][0]["text"]
    assert "--> .send() [method] [EXTRACTED]" in call("get_node", label="Client")["content"][0]["text"]
    assert "Shortest path (1 hops)" in call("shortest_path", source="client", target="send")["content"][0]["text"]
    assert call("shortest_path", source="client", target="far")["content"][0]["text"] == "No path found."
    assert call("nothing")["isError"] and serve.handle(g, {"method": "notifications/initialized"}) is None
    assert serve.handle(g, {"id": 2, "method": "other"})["error"]["code"] == -32601


def test_depth_first_walk_takes_hubs_into_account(spark):
    g, n, links = random_graph(spark, 9)
    nodes, edges = traverse.expand_depth_first(g, ["n1"], budget=10)
    assert nodes[0] == "n1" and len(nodes) <= 10 and all(a != b for a, b in edges)


def test_depth_first_walk_goes_on_with_the_next_seed(spark):
    """Where hubs end the first seed's walk early, the budget is filled from the second; also where the two are not linked."""
    tree = {"r1": ["h1", "h2"], "r2": ["h3", "n4"], "h1": [f"a{k}" for k in range(60)], "h2": [f"b{k}" for k in range(60)], "h3": [f"c{k}" for k in range(60)], "n4": ["d0", "d1"], "c1": ["e0", "e1"], "d1": ["f0"]}
    names = list(dict.fromkeys(["r1", "r2", *(x for near in tree.values() for x in near)]))
    g = graph(spark, [(k, x, x, "code", "f.py", 0) for k, x in enumerate(names)], [(k, s, t, "uses", "EXTRACTED", 1.0) for k, (s, t) in enumerate((s, t) for s, near in tree.items() for t in near)])
    # r1: its hubs are not passed; h3 is a seed and passed in any case
    nodes, _ = traverse.expand_depth_first(g, ["r1", "h3"], budget=69)
    assert nodes == ["r1", "h3", "h1", "h2", "r2", "n4", "c0", "c1", "e0", "e1", *(f"c{k}" for k in range(2, 60))]


def test_god_nodes_leave_files_and_stubs_out(spark):
    nodes = [(1, "f", "f.py", "code", "a/f.py", 0), (2, "m", ".m()", "code", "a/f.py", 0), (3, "c", "C", "code", "a/f.py", 0), (4, "s", "S", "code", "", 0), (5, "str", "str", "code", "a/f.py", 0), (6, "k", "name", "code", "p.json", 0)]
    links = [(k, "c", t, "r", None, 1.0) for k, t in enumerate(["f", "m", "s", "str", "k"])]
    assert [r["id"] for r in metrics.god_nodes(graph(spark, nodes, links)).collect()] == ["c"]
