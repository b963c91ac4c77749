"""Property graphs derived from the driver's tables, and the same graphs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import PropertyGraph


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (table, key, label, partition by nation, first ord) of the star graph's nodes.
_KINDS = (
    ("region", "r_regionkey", "r_name", "25 + r_regionkey", 0),
    ("nation", "n_nationkey", "n_name", "n_nationkey", 10**9),
    ("customer", "c_custkey", "c_name", "c_nationkey", 2 * 10**9),
    ("supplier", "s_suppkey", "s_name", "s_nationkey", 3 * 10**9),
    ("part", "p_partkey", "p_name", "p_partkey % 25", 4 * 10**9),
)
#: (table, source kind, source key, target kind, target key, relation, first ord)
_CONTAINS = (
    ("nation", "region", "n_regionkey", "nation", "n_nationkey", "contains", 0),
    ("customer", "nation", "c_nationkey", "customer", "c_custkey", "contains", 10**9),
    ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "references", 2 * 10**9),
)
_FLAG = "case max(l_returnflag) when 'A' then 'AMBIGUOUS' when 'R' then 'INFERRED' else 'EXTRACTED' end"


def star(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers and parts; who buys and who sells which part."""
    nodes = [
        _read(spark, sf_dir, t).selectExpr(f"{first} + {key} as ord", f"concat('{t}_', {key}) as id", f"{label} as label", "'code' as file_type", f"'{t}.tbl' as source_file", f"cast({part} as int) as community")
        for t, key, label, part, first in _KINDS
    ]
    links = [
        _read(spark, sf_dir, t).selectExpr(f"{first} + {tk} as ord", f"concat('{s}_', {sk}) as source", f"concat('{g}_', {tk}) as target", f"'{rel}' as relation", "'EXTRACTED' as confidence", "cast(1 as double) as weight")
        for t, s, sk, g, tk, rel, first in _CONTAINS
    ]
    item = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    bought = item.join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = bought.groupBy("o_custkey", "l_partkey").agg(F.expr(_FLAG).alias("confidence"), F.count("*").cast("double").alias("weight"))
    sold = item.groupBy("l_suppkey", "l_partkey").agg(F.expr(_FLAG).alias("confidence"), F.count("*").cast("double").alias("weight"))
    links.append(bought.selectExpr("3000000000 + o_custkey * 10000000 + l_partkey as ord", "concat('customer_', o_custkey) as source", "concat('part_', l_partkey) as target", "'uses' as relation", "confidence", "weight"))
    links.append(sold.selectExpr("3000000000000000 + l_suppkey * 10000000 + l_partkey as ord", "concat('supplier_', l_suppkey) as source", "concat('part_', l_partkey) as target", "'references' as relation", "confidence", "weight"))
    union = lambda frames: frames[0].unionByName(frames[1]) if len(frames) == 2 else union(frames[:-1]).unionByName(frames[-1])
    return PropertyGraph(union([n.withColumn("ord", F.col("ord").cast("long")) for n in nodes]), union([x.withColumn("ord", F.col("ord").cast("long")) for x in links]))


def clubs(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations with their customers and suppliers; a thin link leads from each nation to the next."""
    g = star(spark, sf_dir)
    nodes = g.nodes.where("id like 'nation%' or id like 'customer%' or id like 'supplier%'")
    inside = g.links.where("source like 'nation%'")
    nation = _read(spark, sf_dir, "nation")
    thin = nation.where("n_nationkey > 0").selectExpr("cast(5000000000 + n_nationkey as long) as ord", "concat('nation_', n_nationkey - 1) as source", "concat('nation_', n_nationkey) as target", "'next' as relation", "'EXTRACTED' as confidence", "cast(0.001 as double) as weight")
    return PropertyGraph(nodes, inside.unionByName(thin))


def dirty(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The star graph with repeated and missing ids, repeated, dangling and incomplete links, unknown confidences, stubs."""
    g = star(spark, sf_dir)
    again = g.nodes.where("id like 'supplier%'").selectExpr("ord + 50000000000 as ord", "if(ord % 7 = 0, null, id) as id", "concat(label, ' again') as label", "file_type", "source_file", "community")
    stubs = g.nodes.where("id like 'nation%'").selectExpr("ord + 60000000000 as ord", "concat('ref_', id) as id", "concat('.', label, '()') as label", "file_type", "'' as source_file", "cast(null as int) as community")
    more = g.links.where("relation = 'references'").selectExpr("ord + 4000000000000000 as ord", "if(ord % 5 = 0, null, source) as source", "if(ord % 3 = 0, 'nowhere', target) as target", "if(ord % 11 = 0, null, relation) as relation", "if(ord % 4 = 0, 'GUESSED', confidence) as confidence", "weight + 1 as weight")
    to_stub = g.nodes.where("id like 'nation%'").selectExpr("ord + 9000000000000000 as ord", "'region_0' as source", "concat('ref_', id) as target", "'references' as relation", "'INFERRED' as confidence", "cast(1 as double) as weight")
    return PropertyGraph(g.nodes.unionByName(again).unionByName(stubs), g.links.unionByName(more).unionByName(to_stub))


def web(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Pages and what they link to; targets that are no page of the table are sourceless."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)).alias("hrefs"))
    links = pages.select("page_id", "url", F.posexplode("hrefs").alias("pos", "href"))
    links = links.select((F.col("page_id") * 10000 + F.col("pos")).alias("ord"), F.col("url").alias("source"), F.col("href").alias("target"), F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"))
    nodes = pages.select(F.col("page_id").alias("ord"), F.col("url").alias("id"), F.col("url").alias("label"), F.lit("document").alias("file_type"), F.col("url").alias("source_file"), F.lit(None).cast("int").alias("community"))
    return PropertyGraph(nodes, links)


def _star_sql() -> str:
    nodes = " union all ".join(
        f"select {first}::bigint + {key} as ord, '{t}_' || {key} as id, {label} as label, 'code' as file_type, '{t}.tbl' as source_file, ({part})::int as community from {t}" for t, key, label, part, first in _KINDS
    )
    links = " union all ".join(
        f"select {first}::bigint + {tk} as ord, '{s}_' || {sk} as source, '{g}_' || {tk} as target, '{rel}' as relation, 'EXTRACTED' as confidence, 1::double as weight from {t}" for t, s, sk, g, tk, rel, first in _CONTAINS
    )
    return f"""nodes as materialized ({nodes}),
        links as materialized ({links}
            union all select 3000000000 + o_custkey * 10000000 + l_partkey, 'customer_' || o_custkey, 'part_' || l_partkey, 'uses', {_FLAG}, count(*)::double from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey
            union all select 3000000000000000 + l_suppkey * 10000000 + l_partkey, 'supplier_' || l_suppkey, 'part_' || l_partkey, 'references', {_FLAG}, count(*)::double from lineitem group by l_suppkey, l_partkey)"""


STAR = _star_sql()
DIRTY = (
    STAR.replace("nodes as", "nodes0 as", 1).replace("links as", "links0 as", 1)
    + """, nodes as materialized (select * from nodes0
            union all select ord + 50000000000, case when ord % 7 = 0 then null else id end, label || ' again', file_type, source_file, community from nodes0 where id like 'supplier%'
            union all select ord + 60000000000, 'ref_' || id, '.' || label || '()', file_type, '', null from nodes0 where id like 'nation%'),
        links as materialized (select * from links0
            union all select ord + 4000000000000000, case when ord % 5 = 0 then null else source end, case when ord % 3 = 0 then 'nowhere' else target end, case when ord % 11 = 0 then null else relation end,
                case when ord % 4 = 0 then 'GUESSED' else confidence end, weight + 1 from links0 where relation = 'references'
            union all select ord + 9000000000000000, 'region_0', 'ref_' || id, 'references', 'INFERRED', 1 from nodes0 where id like 'nation%')"""
)
WEB = """pages1 as (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 as pos from pages),
        links as materialized (select page_id * 10000 + pos as ord, url as source, href as target, 'references' as relation, 'EXTRACTED' as confidence, 1::double as weight from pages1),
        nodes as materialized (select page_id as ord, url as id, url as label, 'document' as file_type, url as source_file, null::int as community from pages)"""
