"""Registered queries of readers, extractors and exports, and their SQL where it can state them."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..export import pictures, text_formats
from ..functions import text as T
from ..operators.resolve import resolve_corpus
from ..sources import documents, files
from ..tables import scratch
from .testgraphs import DIRTY, STAR, dirty, star

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A small corpus for the extractors; its graph is written out in the statements below.
CORPUS = {
    "pkg/models.py": 'class Base:\n    """The base of all models in here."""\n\n    def save(self, path: str):\n        check(path)\n\n\ndef check(path):\n    return path\n',
    "pkg/client.py": "import os\nfrom models import Base, check\n\n\nclass Client(Base):\n    def run(self):\n        check(os)\n",
    "web/app.ts": "import { start } from './server';\n\nexport class App {\n    run(): void {\n        boot();\n    }\n}\n\nfunction boot(): void {\n    start();\n}\n",
    "srv/main.go": 'package main\n\nimport "fmt"\n\ntype Server struct {\n    name string\n}\n\nfunc (s *Server) Start() {\n    fmt.Println(s.name)\n}\n\nfunc main() {\n    s := Server{}\n    s.Start()\n}\n',
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v.encode())) for k, v in sorted(CORPUS.items())], "file string, content binary")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in rows)


#: (source, target, relation) of the corpus after resolution.
STATED = [
    ("pkg_models", "pkg_models_base", "contains"), ("pkg_models_base", "pkg_models_base_save", "method"), ("pkg_models", "pkg_models_check", "contains"), ("pkg_models_base_save", "pkg_models_check", "calls"),
    ("pkg_models_rationale_2", "pkg_models_base", "rationale_for"), ("pkg_client", "os", "imports"), ("pkg_client", "pkg_models", "imports_from"), ("pkg_client", "pkg_client_client", "contains"),
    ("pkg_client_client", "pkg_models_base", "inherits"), ("pkg_client_client", "pkg_client_client_run", "method"), ("pkg_client", "pkg_models_base", "imports"), ("pkg_client", "pkg_models_check", "imports"),
    ("pkg_client_client", "pkg_models_base", "uses"), ("pkg_client_client_run", "pkg_models_check", "calls"), ("web_app", "web_server", "imports_from"), ("web_app", "web_server_start", "imports"), ("web_app", "web_app_app", "contains"),
    ("web_app_app", "web_app_app_run", "method"), ("web_app", "web_app_boot", "contains"), ("web_app_app_run", "web_app_boot", "calls"), ("srv_main", "go_pkg_fmt", "imports_from"), ("srv_main", "srv_server", "contains"),
    ("srv_server", "srv_server_start", "method"), ("srv_main", "srv_main_main", "contains"), ("srv_main_main", "srv_server_start", "calls"),
]


@query(f"select * from (values {_values(STATED)}) v(source, target, relation)")
def extract_and_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_corpus(files.extract_files(_corpus(spark))).links.select("source", "target", "relation")


@query("select file, n::bigint as n from (values ('pkg/client.py', 3), ('pkg/models.py', 5), ('srv/main.go', 4), ('web/app.ts', 4)) v(file, n)")
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = files.extract_files(_corpus(spark)).graph.nodes.where("source_file <> ''")
    return nodes.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("n"))


def _last(mark: str) -> str:
    """Where ``mark`` stands last in ``w``, from 0; -1 without it."""
    return f"case when contains(w, {mark}) then length(w) - instr(reverse(w), reverse({mark})) + 1 - length({mark}) else -1 end"


@query(f"""with recursive d as (select doc_id, coalesce(text, '') as text from documents),
    cut as (select doc_id, -1 as chunk, 0::bigint as beg, 0::bigint as fin, text, '' as w from d
        union all select doc_id, chunk + 1, fin, fin + case when fin + 800 >= length(text) then length(text) - fin when p1 > 0 then p1 + 1 when p2 > 0 then p2 + 2 when p3 > 0 then p3 + 1 else 800 end, text, w
        from (select *, {_last("chr(10) || '#'")} as p1, {_last("chr(10) || chr(10)")} as p2, {_last("chr(10)")} as p3
            from (select doc_id, chunk, fin, text, substr(text, fin + 1, 800) as w from cut where fin < length(text) or chunk = -1)))
    select doc_id, chunk::bigint as chunk, substr(text, beg + 1, fin - beg) as text,
        'L' || (1 + length(substr(text, 1, beg)) - length(replace(substr(text, 1, beg), chr(10), ''))) || '-L' ||
        (1 + length(substr(text, 1, greatest(fin - 1, beg))) - length(replace(substr(text, 1, greatest(fin - 1, beg)), chr(10), ''))) as source_location from cut where chunk >= 0""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 200)


@query("select doc_id, md5(coalesce(text, '')) as text_md5, length(coalesce(text, ''))::bigint as n_chars from documents")
def chunks_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents.chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 200)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")
    rows = parts.groupBy("doc_id").agg(text.alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.char_length("t").cast("long").alias("n_chars"))


@query(r"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents),
    heads as (select doc_id, n, length(regexp_extract(line, '^(#{1,6})\s+(.+)', 1)) as level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)', 2)) as title from lines where regexp_matches(line, '^#{1,6}\s+.')),
    nested as (select h.doc_id, h.n, h.title, max(p.n) as parent from heads h left join heads p on p.doc_id = h.doc_id and p.n < h.n and p.level < h.level
        and not exists (select 1 from heads m where m.doc_id = h.doc_id and m.n > p.n and m.n < h.n and m.level <= p.level) group by all)
    select doc_id, n::bigint as line, title, coalesce(parent, 0)::bigint as parent_line from nested""")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown reader over all texts: each heading and the one that contains it."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    rows = documents.structure_rows(texts)
    line = lambda c: F.regexp_extract(c, r"\d+", 0).cast("long")
    heads = rows.where("kind = 'node' and idx > 0").select("file", F.col("a").alias("id"), F.col("b").alias("title"), line(F.col("e")).alias("line"))
    inside = rows.where("kind = 'link' and c = 'contains'").select("file", F.col("b").alias("id"), F.col("a").alias("parent"))
    parents = heads.select("file", F.col("id").alias("parent"), F.col("line").alias("parent_line"))
    joined = heads.join(inside, ["file", "id"]).join(parents, ["file", "parent"], "left")
    return joined.select(F.regexp_replace("file", r"\.md$", "").cast("long").alias("doc_id"), "line", "title", F.coalesce("parent_line", F.lit(0)).cast("long").alias("parent_line"))


@query("""select 'documents_doc_id_c0' as id, 'doc_id' as label, 0::bigint as column_index union all select 'documents_lang_c1', 'lang', 1 union all select 'documents_n_chars_c2', 'n_chars', 2
    union all select 'documents_csv', 'documents.csv', least(count(*), 1000) + case when count(*) > 1000 then 100000 else 0 end from documents""")
def csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV reader over the table written as CSV: its columns, and the table's row count (with 100000 where it is cut)."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat_ws(",", F.col("doc_id").cast("string"), "lang", F.col("n_chars").cast("string")).alias("line"))
    # one file is one row: at most one line more than the reader counts
    lines = F.slice(F.collect_list("line"), 1, 2000)
    content = F.concat(F.lit("doc_id,lang,n_chars\n"), F.array_join(lines, "\n"))
    files_ = rows.limit(2000).agg(content.alias("t")).select(F.lit("documents.csv").alias("file"), F.encode("t", "UTF-8").alias("content"))
    found = documents.structure_rows(files_).where("kind = 'node'")
    extra = lambda k: F.get_json_object("extra", f"$.{k}")
    index = F.when(F.col("idx") == 0, extra("row_count").cast("long") + F.when(extra("rows_truncated") == "true", 100000).otherwise(0)).otherwise(extra("column_index").cast("long"))
    return found.select(F.col("a").alias("id"), F.col("b").alias("label"), index.alias("column_index"))


def _office(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return data.getvalue()


_W, _S = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: A folder of documents, as bytes.
PAPERS = {
    "notes/plan.md": b"# Plan\nSee [the cart](./cart.md#top) and [[Budget|money]].\n## Steps\n```\n# no heading\n```\n# Plan\n![pic](x.md) [site](https://example.org)\n",
    "notes/rates.tsv": b"day\trate\t\n1\t2\t3\n4\t5\t6\n",
    "notes/run.ipynb": b'{"cells": [{"cell_type": "markdown", "source": ["# Run\\n", "it"]}, {"cell_type": "code", "source": "1 + 1  \\n"}, {"cell_type": "code", "source": "  "}]}',
    "notes/letter.docx": _office({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:p><w:r><w:t>Dear </w:t></w:r><w:r><w:t>all</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Bye</w:t></w:r></w:p></w:document>'}),
    "notes/book.xlsx": _office({
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_S}"><si><t>name</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row/><row><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    }),
    "notes/.hidden/skip.md": b"# Skipped\n",
}


def _put(spark: SparkSession, contents: dict[str, bytes]) -> str:
    """Writes files into a new folder of the scratch folder."""
    root = f"{scratch(spark)}/files-{uuid.uuid4().hex}"
    jvm = spark._jvm
    for name, data in contents.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(data)
        out.close()
    return root


@query(r"""select * from (values ('notes/book.xlsx', '## Sheet: One' || chr(10) || '| name |  | 7 |' || chr(10) || '|  | true |  |'), ('notes/letter.docx', 'Dear all' || chr(10) || 'Bye'),
    ('notes/run.ipynb', '# Run' || chr(10) || 'it' || chr(10) || chr(10) || '```' || chr(10) || '1 + 1' || chr(10) || '```')) v(file, text)""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks and office files of a folder as texts."""
    return documents.read_texts(spark, _put(spark, PAPERS), ["ipynb", "docx", "xlsx"])


@query("""select * from (values ('notes_plan_md', 'contains', 'notes_plan_plan'), ('notes_plan_md', 'references', 'notes_cart_md'), ('notes_plan_md', 'references', 'notes_budget_md'), ('notes_plan_plan', 'contains', 'notes_plan_steps'),
    ('notes_plan_md', 'contains', 'notes_plan_plan_7'), ('notes_rates_tsv', 'contains', 'notes_rates_day_c0'), ('notes_rates_tsv', 'contains', 'notes_rates_rate_c1')) v(source, relation, target)""")
def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown and tables of a folder as a graph."""
    return documents.read_structure(spark, _put(spark, PAPERS)).links.select("source", "relation", "target")


@query(f"select * from (values {_values(STATED)}) v(source, target, relation)")
def scan_and_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus again, from a folder that also holds what a scan leaves out."""
    more = {".git/x.py": "class A: pass\n", "node_modules/y.js": "function f() {}\n", "pkg/readme.txt": "no code\n"}
    return files.build(spark, _put(spark, {k: v.encode() for k, v in (CORPUS | more).items()})).links.select("source", "target", "relation")


@query(f"with {STAR} select ord, 'MERGE (n:Code {{id: ''' || id || ''', label: ''' || label || '''}});' as line from nodes")
def cypher_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_formats.cypher_nodes(star(spark, sf_dir))


@query(f"""with {DIRTY} select ord, 'MATCH (a {{id: ''' || coalesce(source, '') || '''}}), (b {{id: ''' || coalesce(target, '') || '''}}) MERGE (a)-[:' || upper(coalesce(relation, 'RELATES_TO')) || ' {{confidence: ''' || coalesce(confidence, 'EXTRACTED') || '''}}]->(b);' as line from links""")
def cypher_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_formats.cypher_links(dirty(spark, sf_dir))


@query(f"""with {STAR} select 0 as part, ord, '    <node id="' || id || '">' || chr(10) || '      <data key="d0">' || label || '</data>' || chr(10) || '      <data key="d1">' || file_type || '</data>' || chr(10)
    || '      <data key="d2">' || source_file || '</data>' || chr(10) || '      <data key="d3">' || community || '</data>' || chr(10) || '    </node>' as line from nodes""")
def graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_formats.graphml_body(star(spark, sf_dir)).where("part = 0")


@query(f"""with {STAR}, deg as (select id, count(*) as degree from (select source as id from links union all select target from links) group by id)
    select n.id, coalesce(degree, 0)::bigint as degree, round(10 + 30 * coalesce(degree, 0) / (select max(degree) from deg), 1)::double as size,
    ['#4E79A7', '#F28E2B', '#E15759', '#76B7B2', '#59A14F', '#EDC948', '#B07AA1', '#FF9DA7', '#9C755F', '#BAB0AC'][community % 10 + 1] as color from nodes n left join deg using (id)""")
def drawn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.drawn_nodes(star(spark, sf_dir)).select("id", "degree", "size", "color")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(rf"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' and not regexp_full_match(x, '[a-z]{{1,2}}')) as w from documents),
    c as (select doc_id, w, list_filter(w, lambda x: x not in ({_STOP})) as content from t)
    select doc_id, case when len(content) > 0 then content else w end as terms from c""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.query_terms(F.col("text")).alias("terms"))
