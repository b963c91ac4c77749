"""Registered queries of the graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster, dedupe, integrity, metrics, report, traverse
from ..tables import stored
from .testgraphs import DIRTY, STAR, WEB, clubs, dirty, star, web

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with recursive {graph}{', ' + sql.strip()[5:] if sql.strip().startswith('with ') else ' ' + sql}" if graph else sql
        return f

    return register


#: Shared by several statements below.
_LIVE = "live as materialized (select * from links where source in (select id from nodes) and target in (select id from nodes))"
_UND = _LIVE + """, deg as materialized (select n.id, coalesce(d.degree, 0)::bigint as degree from (select distinct id from nodes where id is not null) n left join (
    select id, count(*) as degree from (select source as id from live union all select target from live where target <> source) group by id) d using (id))"""
_DIR = _LIVE + """, deg as materialized (select n.id, coalesce(d.degree, 0)::bigint as degree from (select distinct id from nodes where id is not null) n left join (
    select id, count(*) as degree from (select source as id from live union all select target from live) group by id) d using (id))"""


@query("""select 'missing id' as kind, ord, 'id' as detail from nodes where id is null
    union all select 'duplicate id', ord, id from (select *, row_number() over (partition by id order by ord) as n from nodes where id is not null) where n > 1
    union all select 'missing key', ord, 'source' from links where source is null union all select 'missing key', ord, 'target' from links where target is null
    union all select 'missing key', ord, 'relation' from links where relation is null
    union all select 'invalid confidence', ord, confidence from links where confidence not in ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')""", DIRTY)
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.validation_errors(dirty(spark, sf_dir))


@query("""select ord, 'source' as "end", source as id from links where source is not null and source not in (select id from nodes where id is not null)
    union all select ord, 'target', target from links where target is not null and target not in (select id from nodes where id is not null)""", DIRTY)
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.dangling_links(dirty(spark, sf_dir))


@query("select source, target, count(*) as n from links where target not in (select id from nodes) group by source, target", WEB)
def web_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = web(spark, sf_dir)
    ends = integrity.dangling_links(g).where(F.col("end") == "target").select("ord")
    return g.links.join(ends, "ord").groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""select id, min(ord) as ord, arg_max(label, ord) as label, arg_max(file_type, ord) as file_type, arg_max(source_file, ord) as source_file, (list(community order by ord desc))[1] as community
    from nodes where id is not null group by id""", DIRTY)
def dedupe_nodes_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_nodes(dirty(spark, sf_dir).nodes)


@query("""select ord, source, target, relation, confidence, weight from (
    select *, row_number() over (partition by coalesce(source, ''), coalesce(target, ''), coalesce(relation, '') order by ord) as n from links) where n = 1""", DIRTY)
def dedupe_edges_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_links(dirty(spark, sf_dir).links)


@query(r"""with keyed as (select id, source_file, regexp_replace(regexp_replace(trim(label), '^[()]+|[()]+$', '', 'g'), '^\.+', '') as k from nodes where id is not null and file_type = 'code'
        and trim(label) <> '' and not regexp_matches(label, '\.(py|js|ts|tsx|java|go|rs)$')),
    real as (select k, min(id) as to_id from keyed where coalesce(source_file, '') <> '' and k <> '' group by k having count(distinct id) = 1),
    remap as (select distinct keyed.id as from_id, to_id from keyed join real using (k) where coalesce(source_file, '') = '' and keyed.id <> to_id)
    select ord, coalesce(a.to_id, source) as source, coalesce(b.to_id, target) as target, relation, confidence, weight from links left join remap a on source = a.from_id left join remap b on target = b.from_id""", DIRTY)
def stub_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dirty(spark, sf_dir)
    return dedupe.collapse_stubs(g.nodes, g.links)[1]


@query(f"with {_UND} select * from deg", STAR)
def degree_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degree_undirected(star(spark, sf_dir))


@query(f"with {_DIR} select * from deg", STAR)
def degree_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degree_directed(star(spark, sf_dir))


@query("""select id, sum(n)::bigint as degree from (select source as id, 1 as n from links union all select target, 1 from links union all select id, 0 from nodes) where id is not null group by id""", WEB)
def degree_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degree_export(web(spark, sf_dir))


@query(f"with {_DIR} select greatest(degree, 50)::bigint as hub_threshold from (select degree, row_number() over (order by degree) as r, count(*) over () as n from deg) where r = n * 99 // 100 + 1", STAR)
def hub_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hub_threshold(star(spark, sf_dir))


@query(f"""with {_UND} select row_number() over (order by degree desc, ord)::bigint as rank, id, label, degree from (
    select n.*, degree from nodes n join deg using (id) where label <> split_part(source_file, '/', -1) and not (label like '.%()') and not (label like '%()' and degree <= 1) and source_file like '%.%'
    order by degree desc, ord limit 10)""", STAR)
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.god_nodes(star(spark, sf_dir), 10)


@query(f"""with {_UND}, first as (select least(source, target) as lo, greatest(source, target) as hi, arg_min(relation, ord) as relation, arg_min(confidence, ord) as confidence from links group by all),
    scored as (select l.ord, s.label as source, t.label as target, s.source_file, t.source_file as target_file, f.confidence, f.relation,
        case f.confidence when 'AMBIGUOUS' then 3 when 'INFERRED' then 2 else 1 end + (s.community <> t.community)::int + (least(ds.degree, dt.degree) <= 2 and greatest(ds.degree, dt.degree) >= 5)::int as score
        from live l join first f on lo = least(l.source, l.target) and hi = greatest(l.source, l.target) join nodes s on s.id = l.source join nodes t on t.id = l.target join deg ds on ds.id = l.source join deg dt on dt.id = l.target
        where f.relation not in ('imports', 'imports_from', 'contains', 'method') and s.source_file <> t.source_file)
    select row_number() over (order by score desc, ord)::bigint as rank, source, target, source_file, target_file, confidence, relation, score::bigint as score from (select * from scored order by score desc, ord limit 20)""", STAR)
def surprising_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star(spark, sf_dir)
    return metrics.surprising_connections(g, g.nodes.select("id", "community"), 20)


@query("""select (select count(distinct nullif(source_file, '')) from nodes) as files, (select count(*) from nodes) as nodes, count(*) as links,
    round(count(*) filter (confidence is null or confidence not in ('INFERRED', 'AMBIGUOUS'))::double / count(*) * 100)::bigint as extracted_pct, round(count(*) filter (confidence = 'INFERRED')::double / count(*) * 100)::bigint as inferred_pct,
    round(count(*) filter (confidence = 'AMBIGUOUS')::double / count(*) * 100)::bigint as ambiguous_pct from links""", DIRTY)
def confidence_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(dirty(spark, sf_dir))


@query(f"with {_LIVE} select u, v, sum(w)::double as w from (select source as u, target as v, weight as w from live union all select target, source, weight from live) group by u, v", STAR)
def weighted_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_adjacency(star(spark, sf_dir))


@query(f"""with {_LIVE}, adj as (select source as u, target as v, weight as w from live union all select target, source, weight from live),
    per as (select a.community, sum(w) as tot, coalesce(sum(w) filter (a.community = b.community), 0) as intra from adj join nodes a on a.id = u join nodes b on b.id = v group by a.community)
    select round(sum(intra) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 9) as modularity from per""", STAR)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star(spark, sf_dir)
    return metrics.modularity(g, g.nodes.select("id", "community")).select(F.round("modularity", 9).alias("modularity"))


@query(f"""with {_LIVE}, size as (select community, count(*) as members from nodes group by community),
    inside as (select a.community, count(*) as n from live join nodes a on a.id = source join nodes b on b.id = target where a.community = b.community and source <> target group by a.community)
    select s.community, members, case when members <= 1 then 1 else coalesce(n, 0) / (members * (members - 1) / 2) end::double as cohesion from size s left join inside using (community)""", STAR)
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star(spark, sf_dir)
    return metrics.cohesion(g, g.nodes.select("id", "community"))


_TOK = r"array_to_string(list_filter(regexp_split_to_array(lower(label), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ')"


@query(f"""select tier::bigint as tier, ord, id, label from (select *, case when id = 'blue_bolt' then 0 when t = 'blue bolt' or lower(id) = 'blue bolt' then 1 when starts_with(t, 'blue bolt') then 2 when contains(t, 'blue bolt') then 3 end as tier
    from (select *, {_TOK} as t from nodes)) where tier is not null""", STAR)
def find_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.find_nodes(star(spark, sf_dir), "Blue Bolt")


@query(f"""with {_LIVE} select 'out' as direction, l.ord, n.label as neighbor, relation, confidence from live l join nodes n on n.id = target where source = 'supplier_3' and relation like '%ref%'
    union all select 'in', l.ord, n.label, relation, confidence from live l join nodes n on n.id = source where target = 'supplier_3' and relation like '%ref%'""", STAR)
def neighbors_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighbors(star(spark, sf_dir), "supplier_3", "REF")


@query(f"""with {_LIVE} select direction, relation, count(*) as n from (select 'out' as direction, relation from live where source = 'nation_7' union all select 'in', relation from live where target = 'nation_7') group by all""", STAR)
def explain_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star(spark, sf_dir)
    return traverse.neighbors(g, "nation_7").groupBy("direction", "relation").agg(F.count("*").alias("n"))


@query(f"""with {_DIR}, hub as (select greatest(degree, 50) as h from (select degree, row_number() over (order by degree) as r, count(*) over () as n from deg) where r = n * 99 // 100 + 1),
    adj as (select distinct id, near from (select source as id, target as near from live union all select target, source from live)),
    l0 as (select 0 as rank, 'region_1' as id union all select 1, 'nation_3'),
    l1 as (select near as id, arg_min(f.id, f.rank) as parent, min(f.rank) as pr from l0 f join adj using (id) where near not in (select id from l0) group by near),
    r1 as (select 1 + row_number() over (order by pr, n.ord) as rank, l1.id, parent from l1 join nodes n on n.id = l1.id),
    f1 as (select r1.* from r1 join deg using (id), hub where degree < h and rank < 500),
    l2 as (select near as id, arg_min(f.id, f.rank) as parent, min(f.rank) as pr from f1 f join adj using (id) where near not in (select id from l0 union all select id from r1) group by near),
    r2 as (select (select count(*) from r1) + 1 + row_number() over (order by pr, n.ord) as rank, l2.id, parent from l2 join nodes n on n.id = l2.id)
    select rank::bigint as rank, id, parent, layer from (select rank, id, null as parent, 0 as layer from l0 union all select rank, id, parent, 1 from r1 union all select rank, id, parent, 2 from r2) where rank < 500""", STAR)
def bfs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.expand(star(spark, sf_dir), ["region_1", "nation_3"], budget=500)


@query(f"""with {_LIVE}, adj as (select distinct id, near from (select source as id, target as near from live union all select target, source from live)),
    walk as (select 'region_0' as id, 0 as d union select near, d + 1 from walk join adj using (id) where d < 5)
    select min(d)::bigint as hops from walk where id = 'part_7'""", STAR)
def shortest_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.shortest_path(star(spark, sf_dir), "region_0", "part_7").agg(F.count("*").alias("hops"))


@query(f"""with {_LIVE}, adj as (select distinct id, near from (select source as id, target as near from live union all select target, source from live)),
    best as (select a.near as n1, b.near as n2 from adj a join adj b on b.id = a.near join adj c on c.id = b.near join nodes x on x.id = a.near join nodes y on y.id = b.near
        where a.id = 'region_0' and c.near = 'part_7' order by x.ord, y.ord limit 1),
    hops as (select 0 as hop, 'region_0' as from_id, n1 as to_id from best union all select 1, n1, n2 from best union all select 2, n2, 'part_7' from best),
    taken as (select hop, from_id, to_id, source = from_id as forward, relation, confidence, row_number() over (partition by hop order by source = from_id desc, l.ord desc) as n
        from hops join live l on (source = from_id and target = to_id) or (source = to_id and target = from_id))
    select hop::bigint as hop, from_id, to_id, forward, relation, confidence from taken where n = 1""", STAR)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.shortest_path(star(spark, sf_dir), "region_0", "part_7")


@query(r"""select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct, ceil(length(text) / 4)::bigint as est_tokens
    from (select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from documents)""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), T.estimate_tokens(F.col("text")).alias("est_tokens"))


@query(r"""select p_partkey, lower(trim(regexp_replace(trim(p_name, '_.') || '_' || trim(p_brand, '_.') || '_' || trim(p_type, '_.'), '[^A-Za-z0-9]+', '_', 'g'), '_')) as id from part""")
def make_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.make_id(F.col("p_name"), F.col("p_brand"), F.col("p_type"), ascii_only=True).alias("id"))


#: Each nation and what it contains is a community; the larger ones come first.
_CLUBS = """with club as (select id, community as c from nodes where id like 'nation%' or id like 'customer%' or id like 'supplier%'),
    number as (select c, row_number() over (order by count(*) desc, min(id)) - 1 as n from club group by c)
    select id, n::int as community from club join number using (c)"""


@query(r"""select doc_id, lower(trim(regexp_replace(nfc_normalize(coalesce(left(text, 60), '')), '(?:[^\p{L}\p{M}\p{Nd}\p{Pc}]|_)+', '_', 'g'), '_')) as id from documents""")
def make_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole recipe, with the Unicode step, on texts in several languages."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.make_id(F.coalesce(F.substring("text", 1, 60), F.lit(""))).alias("id"))


@query(_CLUBS, STAR)
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.exact_communities(clubs(spark, sf_dir))


@query(_CLUBS, STAR)
def communities_synchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.synchronous_communities(clubs(spark, sf_dir))


@query(f"""with {_DIR}, hub as (select greatest(degree, 50) as h from (select degree, row_number() over (order by degree) as r, count(*) over () as n from deg) where r = n * 99 // 100 + 1),
    adj as (select distinct id, near from (select source as id, target as near from live union all select target, source from live)),
    one as (select n.id, n.ord from adj join nodes n on n.id = near where adj.id = 'region_1'),
    two as (select o.ord as first, n.ord, n.id from one o join deg on deg.id = o.id join adj on adj.id = o.id join nodes n on n.id = near, hub where degree < h or o.id = 'nation_3'),
    walk as (select ord as a, 0 as k, ord as b, id from one union all select first, 1, ord, id from two),
    met as (select id, min(struct_pack(a := a, k := k, b := b)) as place from walk where id not in ('region_1', 'nation_3') group by id)
    select rank::bigint as rank, id from (select 0 as rank, 'region_1' as id union all select 1, 'nation_3' union all select 1 + row_number() over (order by place), id from met) where rank < 300""", STAR)
def dfs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = traverse.expand_depth_first(star(spark, sf_dir), ["region_1", "nation_3"], budget=300)
    return spark.createDataFrame(list(enumerate(nodes)), "rank long, id string")


@query("""select community, count(*)::bigint as total, list_aggregate(list(label order by id)[1:8], 'string_agg', ', ') as names from nodes group by community""", STAR)
def report_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star(spark, sf_dir)
    return report.community_members(g, g.nodes.select("id", "community")).select("community", "total", F.array_join("names", ", ").alias("names"))
