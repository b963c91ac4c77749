import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumengraph import tables
from lumengraph.extract import dispatch
from lumengraph.functions import ids
from lumengraph.functions import text as T
from lumengraph.operators.resolve import resolve_corpus
from lumengraph.plans import extractor_queries
from lumengraph.plans.samples import SAMPLES
from lumengraph.sources import documents, files
from lumengraph.streaming import folder


def test_identifiers_agree_with_columns(spark):
    cases = ["Foo.Bar", "__a_.", "Ölçek 模块 x!", "ﬁle", "a//b--c", "", "_._", "ẞ"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(T.make_id(F.col("s"))).collect()]
    assert got == [ids.make_id(c) for c in cases]
    paths = ["a/b/c.py", "c.tar.gz", ".env", "a/.env", "plain", "a/", ".."]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(T.file_stem(F.col("p"))).collect()] == [ids.file_stem(p) for p in paths]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_chunks_are_the_text(spark, size):
    text = "# A\nline one\n\npara two is longer\n# B\n" + "x" * 100 + "\nend"
    rows = documents.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), size).orderBy("doc_id", "chunk").collect()
    assert "".join(r["text"] for r in rows if r["doc_id"] == 1) == text
    assert all(len(r["text"]) <= size * 4 for r in rows)
    assert rows[0]["source_location"].startswith("L1-")


def test_markdown_headings_and_links():
    e = documents.extract_markdown("d/a.md", "# T\n[x](./b.md#s) ![i](c.md) [w](https://e.org)\n```\n# no\n```\n## S\n[[wiki|W]]\n[r]: ../up.txt\n# T\n")
    assert [(n["id"], n["label"]) for n in e.nodes] == [("d_a_md", "a.md"), ("d_a_t", "T"), ("d_a_s", "S"), ("d_a_t_9", "T")]
    assert [(x["target"], x["relation"]) for x in e.links] == [("d_a_t", "contains"), ("d_b_md", "references"), ("d_a_s", "contains"), ("d_wiki_md", "references"), ("up_txt", "references"), ("d_a_t_9", "contains")]


def test_tables_notebooks_and_office_files():
    e = documents.extract_csv("t.tsv", "a\t\tb\n1\t2\t3\n\n4\t5\t6\n7\t8\t9\n", 2)
    assert e.nodes[0] | {} == e.nodes[0] and (e.nodes[0]["column_count"], e.nodes[0]["row_count"], e.nodes[0]["rows_truncated"]) == (3, 2, True)
    assert [n["label"] for n in e.nodes[1:]] == ["a", "b"]
    book = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "1 \n"}, {"cell_type": "code", "source": " "}]}
    assert documents.notebook_text(json.dumps(book)) == "# T\nx\n\n```\n1\n```"
    assert documents.notebook_text("no") == ""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>a &amp; </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/></w:d>')
    assert documents.docx_text(data.getvalue()) == "a & b" and documents.docx_text(b"x") == ""


def test_python_corpus_resolves_across_files(spark, tmp_path):
    (tmp_path / "m.py").write_text("class Base:\n    pass\n\n\ndef helper():\n    pass\n")
    (tmp_path / "n.py").write_text("from m import Base, helper as h\n\n\nclass Sub(Base):\n    def go(self):\n        h()\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "z.py").write_text("x = 1\n")
    (tmp_path / "broken.py").write_text("def (:\n")
    g = files.build(spark, str(tmp_path))
    links = {(r["source"], r["target"], r["relation"]) for r in g.links.collect()}
    assert {("n_sub", "m_base", "inherits"), ("n", "m_base", "imports"), ("n_sub", "m_base", "uses"), ("n_sub_go", "m_helper", "calls"), ("n", "m", "imports_from")} <= links
    assert {r["id"] for r in g.nodes.collect()} == {"m", "n", "broken", "m_base", "m_helper", "n_sub", "n_sub_go"}


def test_extractors_never_fail_on_odd_input():
    for ending in dispatch.EXTRACTORS:
        for data in (b"", b"\xff\xfe\x00", b"{", b"class", b"((((", b"function f(", b"\"" * 50):
            dispatch.extract(f"a/x.{ending}", data)
    assert dispatch.extract("x.unknown", b"x").nodes == []


def test_watched_folder_replaces_changed_files(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.py").write_text("def f():\n    pass\n")
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    folder.watch(spark, str(source), table, mark).awaitTermination()
    (source / "b.py").write_text("class C:\n    pass\n")
    folder.watch(spark, str(source), table, mark).awaitTermination()
    rows = folder.current(spark.read.parquet(table)).where("kind = 'node'")
    assert {r["b"] for r in rows.collect()} == {"a.py", "b.py", "f()", "C"}


#: ending -> (source, some links of its graph)
SNIPPETS = {
    "java": ("import java.util.Map;\nclass A extends B implements C {\n  private D d;\n  E make(F f) { return help(f); }\n  E help(F f) { return null; }\n}\n", [("x", "map", "imports"), ("x_a", "b", "inherits"), ("x_a", "c", "implements"), ("x_a", "d", "references"), ("x_a_make", "f", "references"), ("x_a_make", "x_a_help", "calls")]),
    "ts": ("import { q } from './lib/q';\nexport class A extends B {\n  run(n: number): void { go(n); }\n}\nfunction go(n: number) { return n; }\n", [("x", "lib_q", "imports_from"), ("x", "lib_q_q", "imports"), ("x_a", "b", "inherits"), ("x_a_run", "x_go", "calls")]),
    "c": ('#include "list.h"\nstruct node *add(struct item *i) { return 0; }\nint main(void) { add(0); return 0; }\n', [("x", "list", "imports"), ("x_main", "x_add", "calls")]),
    "cs": ("using System.Text;\nnamespace N {\n  class A : B, IC {\n    public D Make(E e) { return Help(e); }\n    private D Help(E e) { return null; }\n  }\n}\n", [("x", "system_text", "imports"), ("x_n_a", "b", "inherits"), ("x_n_a", "ic", "implements"), ("x_n_a_make", "x_n_a_help", "calls")]),
    "rs": ("use std::fmt::Debug;\ntrait T { fn t(&self); }\nstruct S { v: Vec<u8> }\nimpl T for S {\n    fn t(&self) { help(); }\n}\nfn help() {}\n", [("x", "debug", "imports_from"), ("x_s", "x_t", "implements"), ("x_s_t", "x_help", "calls")]),
    "php": ("<?php\nuse A\\B;\nclass C extends D {\n  public function m(B $b): E { return $this->n(); }\n  private function n() {}\n}\n", [("x", "a_b", "imports"), ("x_c", "d", "inherits"), ("x_c_m", "x_c_n", "calls")]),
    "kt": ("class A(val c: Int) : B(), C {\n    fun run(d: D): E { return help(d) }\n    fun help(d: D): E { return E() }\n}\nenum class F { ONE, TWO }\n", [("x_a", "b", "inherits"), ("x_a", "c", "implements"), ("x_a_run", "x_a_help", "calls"), ("x_f", "x_f_one", "case_of")]),
    "rb": ("class A < B\n  def m(x)\n    n(x)\n  end\n  def n(x)\n    x\n  end\nend\n", [("x_a", "b", "inherits"), ("x_a_m", "x_a_n", "calls")]),
    "sh": ("export HOME_DIR=/x\nsetup() {\n  echo hi\n}\nsetup\n", [("x", "x_home_dir", "defines"), ("x", "x_setup", "defines"), ("x_sh__entry", "x_setup", "calls")]),
    "sql": ("create table a (id int);\ncreate table b (a_id int references a(id));\ncreate view v as select * from a join b on true;\n", [("x_b", "x_a", "references"), ("x_v", "x_a", "reads_from"), ("x_v", "x_b", "reads_from")]),
    "tf": ('variable "v" {}\nresource "aws_thing" "t" {\n  name = var.v\n  depends_on = [module.m]\n}\nmodule "m" {}\n', [("aws_thing_t", "var_v", "references"), ("aws_thing_t", "module_m", "depends_on")]),
    "ex": ("defmodule A.B do\n  alias C.{D, E}\n  def f(x) do\n    g(x)\n  end\n  defp g(x), do: x\nend\n", [("x", "c_d", "imports"), ("x", "c_e", "imports"), ("x_a_b_f", "x_a_b_g", "calls")]),
    "sol": ("import './I.sol';\ncontract A is B {\n  function f() public { g(); }\n  function g() public {}\n}\n", [("x", "i", "imports"), ("x_a", "b", "inherits"), ("x_f", "x_g", "calls")]),
    "r": ("library(dplyr)\nf <- function(x) {\n  g(x)\n}\ng <- function(x) x\n", [("x", "dplyr", "imports"), ("x_f", "x_g", "calls")]),
    "json": ('{"name": "n", "dependencies": {"left": "1"}}', [("x_dependencies", "x_dependencies_left", "contains"), ("x_dependencies_left", "left", "imports")]),
    "vue": ("<template/>\n<script lang=\"ts\">\nimport { a } from './a'\nfunction f() { g() }\nfunction g() {}\n</script>\n", [("x", "a", "imports_from"), ("x_f", "x_g", "calls")]),
}


@pytest.mark.parametrize("ending", sorted(SNIPPETS))
def test_snippets(ending):
    source, links = SNIPPETS[ending]
    got = {(x["source"], x["target"], x["relation"]) for x in dispatch.extract(f"x.{ending}", source.encode()).links}
    assert set(links) <= got, sorted(set(links) - got)


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_samples_give_their_stated_graphs(name):
    path, source, _, _ = SAMPLES[name]
    e = dispatch.extract(path, source.encode())
    got = [("node", n["id"], n["label"], n["file_type"], "-") for n in e.nodes] + [("link", x["source"], x["relation"], x["target"], x["context"] or "-") for x in e.links]
    assert sorted(got) == sorted(extractor_queries.stated(name))


def test_order_of_files_in_many_partitions(spark):
    """Ranks have no gaps, and new links come last, however many partitions there are."""
    sources = {f"d{i % 7}/m{i:03d}.py": f"class C{i}:\n    pass\n" for i in range(150)} | {"a.py": "from m000 import C0\n\n\nclass A(C0):\n    pass\n"}
    df = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in sources.items()], "file string, content binary")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        extraction = files.extract_files(df)
        nodes = {r["id"]: r["ord"] for r in extraction.graph.nodes.where("label like '%.py'").collect()}
        links = [r["ord"] for r in extraction.graph.links.select("ord").collect()]
        resolved = resolve_corpus(extraction).links.where("relation in ('imports', 'uses')").select("ord").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    ranks = [nodes[k.removesuffix(".py").replace("/", "_").lower()] // tables.PER_FILE for k in sorted(sources)]
    assert ranks == list(range(len(sources)))
    assert len(resolved) == 2 and min(r["ord"] for r in resolved) > max(links)


def test_link_targets():
    cases = {
        "see [a](b.md) and [c]( <d.md> \"title\" )": ["b.md", "d.md"],
        "![image](x.png) ![[embed]] [[w|x]] [[v#part]]": ["w", "v"],
        "  [label]: <target.md> 'title'": ["target.md"],
        "    [code]: no": [],
        "[open](never closed": [],
        "[[both]] [x](y)": ["y", "both"],
        "[]() [ ] []: x": [],
    }
    for line, want in cases.items():
        assert list(documents.link_targets(line)) == want, line
    assert [documents.heading(x) for x in ("# a ", "###### b", "####### c", "#d", "# ", " # e")] == [(1, "a"), (6, "b"), None, None, None, None]
