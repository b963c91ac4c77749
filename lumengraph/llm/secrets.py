"""Secret scan with multipart credential linking.

Strong spans (named assignments, access-key ids, long hex strings) are reported
wherever they stand.  Weak candidates are account names, bare 40-character keys
and service endpoints; on their own they are mostly innocent.  Within a document
they are interval-joined with the other parts of a credential: a weak part is
reported only when complementary parts stand within ``scope`` characters of it, from
the end of the one to the start of the other (overlapping parts have no distance):
a name needs a secret, a bare key needs an identifier, an endpoint needs both.
Weak candidates inside a strong span, and bare keys inside a name or an endpoint,
are part of that span: they are neither reported nor company.
Of the parts that start before it, the furthest end is compared, of those after it
the next start: running extremes over the spans of a document in order of their start
and back, so the cost is that of two sorts and no pairs are made.

Everything is DataFrame expressions: no Python runs on the rows.

Defined results: a null or empty text has no spans; repeated rows give one row
each; a null doc_id is kept; positions are code points, ends exclusive; spans
that start together are ordered by kind as listed in ``KINDS``; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

#: Kind -> pattern.  The first three are strong; the rest are weak and need company.
KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "ident": r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}""",
    "bare_key": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": r"(?i:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+",
}
_ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: ``first`` and ``past`` are the span's ends in bytes.
_SPAN = "struct<start:int,kind:int,end:int,first:int,past:int>"
#: Matches of a text that are added up in one go.
BLOCK = 512


def _found(gaps: Column, matches: Column, kind: int, keep) -> Column:
    """Spans from the stretches between matches and the matches themselves.

    Positions are sums over all that stands in front, made in blocks of matches and then over blocks:
    an array that grows by one is copied each time.
    """
    none = F.array().cast(f"array<{_SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        start, first = state["at"] + F.char_length(pair["gap"]), state["byte"] + F.octet_length(pair["gap"])
        end, past = start + F.coalesce(F.char_length(pair["match"]), F.lit(0)), first + F.coalesce(F.octet_length(pair["match"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), first.alias("first"), past.alias("past")))
        return F.struct(end.alias("at"), past.alias("byte"), F.when(pair["match"].isNotNull() & keep(pair["match"]), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def of(pairs: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), none.alias("spans"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), begin, step))

    def placed(blocks: Column) -> Column:
        def add(state: Column, block: Column) -> Column:
            return F.struct((state["at"] + block["at"]).alias("at"), (state["byte"] + block["byte"]).alias("byte"), F.concat(state["before"], F.array(F.struct(state["at"].alias("at"), state["byte"].alias("byte")))).alias("before"))

        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), F.array().cast("array<struct<at:int,byte:int>>").alias("before"))
        before = F.aggregate(blocks, begin, add, lambda s: s["before"])
        moved = lambda block, by: F.transform(block["spans"], lambda s: F.struct((s["start"] + by["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + by["at"]).alias("end"), (s["first"] + by["byte"]).alias("first"), (s["past"] + by["byte"]).alias("past")))
        return F.flatten(F.zip_with(blocks, before, moved))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return once(once(pairs, of), placed)


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: the spans of all kinds, strong and weak.

    Bare keys are looked for only beside a name, endpoints only beside a name and a secret: without
    them they are not reported.
    """
    some = lambda *names: F.greatest(F.lit(0), *[F.size(f"gap_{n}") for n in names]) > 1
    for name, pattern in KINDS.items():
        if name in ("bare_key", "endpoint"):
            company = some("access", "ident") & (some("assign", "hex", "bare_key") if name == "endpoint" else F.lit(True))
            rows = rows.withColumn(f"gap_{name}", F.when(company, F.split("text", pattern)).otherwise(F.array().cast("array<string>")))
        else:
            rows = rows.withColumn(f"gap_{name}", F.split("text", pattern))
    parts = []
    for kind, (name, pattern) in enumerate(KINDS.items()):
        keep = (lambda m: F.char_length(F.regexp_extract(m, _ASSIGN_VALUE, 1)) >= 8) if name == "assign" else (lambda m: F.lit(True))
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        parts.append(F.when(F.size(f"gap_{name}") > 1, _found(F.col(f"gap_{name}"), matches, kind, keep)).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return rows.withColumn("candidates", F.concat(*parts)).drop(*[f"gap_{n}" for n in KINDS])


def _linked(spans: DataFrame, key: list[str], scope: int) -> DataFrame:
    """Exploded spans (``start, kind, end`` by ``key``), with a null kind for weak ones without company."""
    names = list(KINDS)
    # ranges take in the spans that start together; both run forward, as a frame that ends with the partition is summed anew for each row
    before = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*key).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda *kinds: F.col("kind").isin([names.index(k) for k in kinds])

    # a weak candidate inside another span says nothing beside it: the characters of one secret are no company for themselves
    inside = lambda *kinds: F.coalesce(F.max(F.when(of(*kinds), F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    weak = of("ident", "bare_key", "endpoint")
    spans = spans.withColumn("inner", (weak & inside("assign", "access", "hex")) | (of("bare_key") & inside("ident", "endpoint")))
    spans = spans.withColumn("kind", F.when(~F.coalesce("inner", F.lit(False)), F.col("kind"))).drop("inner")

    def is_in(*kinds: str) -> Column:
        back = F.col("start") - F.max(F.when(of(*kinds), F.col("end"))).over(before) <= scope
        ahead = F.min(F.when(of(*kinds), F.col("start"))).over(after) - F.col("end") <= scope
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    # rows stay, so that no document is lost; those without spans have a null kind from the start
    spans = spans.withColumn("has_name", is_in("access", "ident")).withColumn("has_secret", is_in("assign", "hex", "bare_key"))
    alone = (of("ident") & ~F.col("has_secret")) | (of("bare_key") & ~F.col("has_name")) | (of("endpoint") & ~(F.col("has_name") & F.col("has_secret")))
    return spans.withColumn("kind", F.when(~alone, F.col("kind"))).drop("has_name", "has_secret")


def _gathered() -> Column:
    return F.sort_array(F.collect_set(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("spans")


def find_secrets(docs: DataFrame, scope: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans`` with an array of ``start, kind, end``, kinds numbered as in ``KINDS``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # names the row in the one pass that follows; nothing reads the input a second time by it
    rows = _candidates(rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", "candidates")
    spans = rows.select("row", "doc_id", F.explode_outer("candidates").alias("s")).select("row", "doc_id", "s.start", "s.kind", "s.end")
    return _linked(spans, ["row"], scope).groupBy("row").agg(F.first("doc_id").alias("doc_id"), _gathered()).drop("row")


def redact(docs: DataFrame, scope: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns and rows with every reported span replaced by ``[kind]``; overlapping spans become one mark, of the first."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = _candidates(docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))).where(F.size("candidates") > 0)
    spans = rows.select("id", "key", F.explode("candidates").alias("s")).select("id", "key", "s.*").distinct()
    # between two marks stands what lies beyond the furthest end so far
    order = Window.partitionBy("id", "key").orderBy("start", "kind", "end")
    so_far = F.coalesce(F.max("past").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = _linked(spans, ["id", "key"], scope).where("kind is not null").withColumn("so_far", so_far)
    mark = F.when(F.col("first") >= F.col("so_far"), F.struct("first", "so_far", "kind"))
    found = found.groupBy("id", "key").agg(F.sort_array(F.collect_list(mark)).alias("marks"), F.max("past").alias("past")).select(F.col("id").alias("found_id"), F.col("key").alias("found_key"), "marks", "past")
    keyed = packed(docs, id=F.col(id_col), key=key, raw=F.encode(F.col(text_col), "UTF-8"))
    joined = keyed.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    # bytes are cut out in time of their number; characters would be counted from the beginning of the text each time
    cut = lambda first, past: F.decode(F.substring(F.col("raw"), first + 1, past - first), "UTF-8")
    clean = F.concat(F.array_join(F.transform("marks", lambda m: F.concat(cut(m["so_far"], m["first"]), F.lit("["), F.get(names, m["kind"]), F.lit("]"))), ""), cut(F.col("past"), F.octet_length("raw")))
    return joined.withColumn("row", F.when(F.col("marks").isNull(), F.col("row")).otherwise(F.col("row").withField(f"`{text_col}`", clean))).select("row.*")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
