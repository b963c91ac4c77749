"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontaminate, licenses, neardup, packing, rules, secrets, sharding, substrings
from .common import table


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(r"""select -7L as conv_id, t as turn, r as role, r'\### Assistant: </turn> ok' as text from values (0L, 'user'), (1L, 'assistant') as v(t, r)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_chat(turns).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


QUERIES = {
    "op5_sharding": op5_sharding,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_packing": op7_packing,
}

ORACLE_SQL = {
    "op6_chat_formatting": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all
            select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
        marked as (
            select *, contains(role, '### ') or contains(text, '### ') or contains(role, ': ') or contains(text, '</turn>') or contains(role, '</turn>')
                or regexp_matches(role || ' ' || text, '\\[hlc\\]') as clash from turns),
        shown as (
            select *, case when clash then replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') else role end
                || case when clash then replace(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') else text end as body from marked)
        select conv_id, count(*)::bigint as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(length(body) + 14)::bigint as formatted_chars
        from shown group by conv_id""",
}


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


QUERIES |= {
    "op8_secret_scan": op8_secret_scan,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL |= {
    "op10_decontamination": r"""
        with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bw as (select distinct item_id, least(len(w), 10) as k, list_slice(w, i, i + least(len(w), 10) - 1) as win
            from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
        dw as (select rid, k, i, list_slice(w, i, i + k - 1) as win
            from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
        hits as (select dw.rid, bw.item_id, dw.i, dw.k from dw join bw on dw.k = bw.k and dw.win = bw.win),
        spots as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from hits) group by rid),
        its as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct rid, item_id from hits) group by rid),
        dp as materialized (select rid, unnest(w) as term, unnest(range(1, len(w) + 1)) as pos from d),
        iw as (select row_number() over () as bk, item_id, w, least(len(w), 10) as k from (select distinct item_id, w from b where len(w) > 0)),
        win as (select bk, item_id, k, i, list_slice(w, i, i + k - 1) as win from (select *, unnest(range(1, len(w) - k + 2)) as i from iw)),
        part as (select bk, item_id, k, i, unnest(win) as term, unnest(range(0, k)) as off from win),
        cnt as (select term, count(*) as n from dp where term in (select term from part) group by term),
        ranked as (select *, row_number() over (partition by bk, i order by n, off) as rn, count(*) over (partition by bk, i) as known from part join cnt using (term)),
        anchor as (select x.bk, x.item_id, x.k, x.i, x.term, x.off, list(y.off) as offs from ranked x join ranked y using (bk, i)
            where (x.known = 1 or x.rn < y.rn) and y.rn <= 3 and x.known >= x.k - x.k // 5 group by all),
        cand as (select distinct rid, bk, item_id, k, i, offs, pos - off as start from dp join anchor using (term)),
        near as (select c.rid, c.item_id from cand c join part p on p.bk = c.bk and p.i = c.i join dp on dp.rid = c.rid and dp.term = p.term and dp.pos between c.start + p.off - 3 and c.start + p.off + 3
            group by c.rid, c.bk, c.item_id, c.k, c.i, c.start, c.offs having count(distinct p.off) >= c.k - c.k // 5 and bool_or(list_contains(c.offs, p.off))),
        nears as (select rid, count(distinct item_id) as n_near from near group by rid)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated, coalesce(n_near, 0)::bigint as n_near
        from d left join spots using (rid) left join its using (rid) left join nears using (rid)""",
}


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.match_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_matches", "license", "dice")


def _license_sql() -> str:
    quote = lambda x: "'" + x + "'"
    known = ", ".join(f"({quote(name)}, [{', '.join(map(quote, grams))}], {n})" for name, grams, n in ((name, *licenses.bigrams_of(text)) for name, text in licenses.TEMPLATES))
    return rf"""
        with t(license, grams, n) as (values {known}),
        d as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        s as (select rid, unnest(case when contains(text, chr(10)) then list_append(string_split(text, chr(10)), text) else [text] end) as seg from d),
        w as (select row_number() over () as sid, rid, regexp_extract_all(seg, '[a-z0-9]+') as words from s),
        b as (select sid, rid, len(words) as n, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) as pairs from w where len(words) between 2 and 80),
        m as (select sid, rid, license, 2.0::double * len(list_intersect(pairs, grams)) / (len(pairs) + len(grams)) as dice
            from b join t on b.n - 1 between (t.n - 1) * (0.8 / 1.2) - 1e-9 and (t.n - 1) * 1.5 + 1e-9),
        per as (select sid, rid, min({{'minus': -dice, 'license': license}}) as best from m where dice >= 0.8::double group by sid, rid),
        doc as (select rid, count(*) as n, min(best) as best from per group by rid)
        select doc_id, coalesce(n, 0)::bigint as n_matches, best.license as license, round(-best.minus, 6) as dice from d left join doc using (rid)"""


QUERIES |= {"op4_quality_rules": op4_quality_rules, "op9_license_scan": op9_license_scan}
ORACLE_SQL |= {"op9_license_scan": _license_sql()}


def op2_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("text_key", "component_key")


QUERIES |= {"op2_minmax_neardup": op2_minmax_neardup}


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model)
    held = F.coalesce(classifier.fold(F.col("doc_id")) == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES |= {"op1_quality_attention": op1_quality_attention}


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES |= {"op3_suffix_dedup": op3_suffix_dedup}
