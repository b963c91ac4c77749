"""Benchmark decontamination with a positional inverted index.

The index is a stored table with one posting (term, document, position) for each
training token, sorted by term inside each of its files, and one row for each
document with its number of words.  Where the test side is small enough to be
broadcast, only postings of its terms are stored; no other is ever looked up.

A test item is cut into windows of ``width`` consecutive terms.  Corpus-wide term
counts order the terms of each window from rare to frequent.  The lists of its two
rarest terms, moved by the terms' offsets, are intersected first: what is left are
places (document, item, diagonal) where both stand as far apart as in the window.
Only the documents of such places are looked up further: the lists of the window's
other terms, moved by their offsets, are intersected with them.  A window all of whose
terms are found is an exact phrase match.  With ``slop``, terms may stand so many words
away from their place beside the rarer one, any two of the three rarest terms are
intersected, and a window is a proximity match when at least four fifths of all its
terms are found beside them.

Every join is on document, term and place, so neither a frequent term nor a long
document meets in one task; terms that are rarest nowhere are only read for the
documents above.  The test side is broadcast only below ``BROADCAST_ROWS`` rows.

Everything is DataFrame expressions: no Python runs on the rows.

Defined results: null or wordless documents have no words and no hit; null or
wordless items match nothing; items of fewer than ``width`` words are one window
of all their words; repeated document rows give one row each; a null doc_id is
kept; repeated items count under each item_id once; an empty side gives zero
hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, packed, stored

#: What separates words in a text whose capitals still stand; every other character belongs to a word.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a side (short rows of ids, places and one word) up to which it is broadcast: some 20 MB.
BROADCAST_ROWS = 200_000
#: Places are joined by cells of so many words.
CELL = 8


def split_words(text: Column) -> Column:
    """The words with their capitals; the first and the last element may be empty."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATOR)


def n_words(words: Column) -> Column:
    return F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")


def terms(text: Column) -> Column:
    """The words with A-Z in lower case."""
    return F.transform(F.filter(split_words(text), lambda w: w != ""), lower_ascii)


def _term(word: Column) -> Column:
    # words of ASCII letters only take the short way
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(lower_ascii(word))


def _sized(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_key, item_id, words`` of items with words; equal texts under one id are one item."""
    rows = items.select(F.col(id_col).alias("item_id"), terms(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct()
    return rows.select(F.xxhash64("item_id", "words").alias("item_key"), "item_id", "words")


def build_index(docs: DataFrame, tested: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, doc, text_key, pos, doc_id``: the postings of ``docs``, or those of the terms in ``tested`` (column ``term``, distinct).

    ``doc`` and ``text_key`` are hashes of id and text, and of the text.  A null term marks a
    document's own row, with its number of words as ``pos``; only that row has the ``doc_id``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("doc"), F.xxhash64(text).alias("text_key"), split_words(F.col(text_col)).alias("words"))
    rows = rows.select("doc_id", "doc", "text_key", n_words(F.col("words")).alias("n_words"), F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("at", "word"))
    rows = rows.withColumn("term", _term(F.col("word")))
    if tested is not None:
        rows = rows.join(F.broadcast(tested.select("term", F.lit(True).alias("asked"))), "term", "left").where(F.col("word").isNull() | F.col("asked"))
    own = F.col("word").isNull()
    return rows.where(own | (F.col("word") != "")).select("term", "doc", "text_key", F.when(own, F.col("n_words")).otherwise(F.col("at")).alias("pos"), F.when(own, F.col("doc_id")).alias("doc_id"))


def store_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the whole index, for any number of test sides."""
    build_index(docs, None, id_col, text_col).sortWithinPartitions("term", "doc", "pos").write.parquet(path)


def _windows(words: DataFrame, counts: DataFrame, n_terms: int, width: int, exact: bool) -> DataFrame:
    """``item_key, i, need, ipos1, term1, others``: each window that can match, by each of its rarest terms but the last, with those less rare.

    Two of its rarest terms count for exact matches, three for others.
    """
    need = F.least(F.size("words"), F.lit(width))
    windows = words.select("item_key", need.alias("need"), F.explode(F.sequence(F.lit(0), F.size("words") - need)).alias("i"), "words")
    parts = windows.select("item_key", "need", "i", F.posexplode(F.slice("words", F.col("i") + 1, F.col("need"))).alias("off", "term")).join(_sized(counts, n_terms), "term")
    ranked = parts.groupBy("item_key", "i", "need").agg(F.sort_array(F.collect_list(F.struct("count", "off", "term"))).alias("r"))
    ranked = ranked.where(F.size("r") >= (F.col("need") if exact else F.col("need") - _lacking()))
    rare = F.transform(F.slice("r", 1, 2 if exact else 3), lambda x: F.struct((F.col("i") + x["off"]).alias("ipos"), x["term"].alias("term")))
    ranked = ranked.select("item_key", "i", "need", rare.alias("rare"))
    ranked = ranked.select("*", F.posexplode(F.slice("rare", F.lit(1), F.greatest(F.size("rare") - 1, F.lit(1)))).alias("n", "one"))
    # a window with one known term has no other beside it
    others = F.when(F.size("rare") == 1, F.col("rare")).otherwise(F.slice("rare", F.col("n") + 2, F.lit(3)))
    return ranked.select("item_key", "i", "need", F.col("one.ipos").alias("ipos1"), F.col("one.term").alias("term1"), others.alias("others"))


def _lacking() -> Column:
    """How many terms a proximity match may lack."""
    return F.floor(F.col("need") / 5).cast("int")


def _cells(place: Column, slop: int) -> Column:
    """The cells that hold the places up to ``slop`` away."""
    return F.array_distinct(F.transform(F.array(place - slop, place + slop), lambda p: F.floor(p / CELL)))


def search(index: DataFrame, words: DataFrame, width: int = 10, slop: int | None = None) -> DataFrame:
    """Windows found in a stored index: ``doc, text_key, item_key, first, last, exact`` (word positions, inclusive).

    Without ``slop`` exact matches only.
    """
    exact, slop = slop is None, slop or 0
    tested = words.select(F.explode("words").alias("term"))
    n_terms = tested.count()
    tested, postings = tested.distinct(), index.where("term is not null").drop("doc_id")
    counts = postings.join(_sized(tested, n_terms), "term", "left_semi").groupBy("term").count()
    windows = stored(_windows(words, counts, n_terms, width, exact))
    n_windows = windows.count()

    pairs = windows.select("item_key", "ipos1", "term1", F.explode("others").alias("o")).select("item_key", "ipos1", "term1", F.col("o.ipos").alias("ipos2"), F.col("o.term").alias("term2"))

    # the lists of the rarest terms, moved to where the item would begin
    def moved(k: int) -> DataFrame:
        places = pairs.select("item_key", f"ipos{k}", F.col(f"term{k}").alias("term")).distinct()
        return postings.join(_sized(places, 2 * n_windows), "term").select("doc", "text_key", "item_key", f"ipos{k}", (F.col("pos") - F.col(f"ipos{k}")).alias(f"begin{k}"))

    one = moved(1).withColumn("cell", F.floor(F.col("begin1") / CELL))
    two = moved(2).withColumn("cell", F.explode(_cells(F.col("begin2"), slop)))
    met = one.join(two, ["doc", "text_key", "item_key", "cell"]).where(F.abs(F.col("begin1") - F.col("begin2")) <= slop)
    met = met.join(_sized(pairs.select("item_key", "ipos1", "ipos2").distinct(), 2 * n_windows), ["item_key", "ipos1", "ipos2"], "left_semi")
    starts = stored(met.select("doc", "text_key", "item_key", "ipos1", "begin1").distinct())

    # the lists of all terms around them, in their documents only
    holders = starts.select("doc", "text_key").distinct()
    lists = postings.join(_sized(holders, holders.count()), ["doc", "text_key"], "left_semi").withColumn("cell", F.floor(F.col("pos") / CELL))
    item = words.select("item_key", "words", F.least(F.size("words"), F.lit(width)).alias("need"))
    around = F.sequence(F.greatest(F.col("ipos1") - F.col("need") + 1, F.lit(0)), F.least(F.col("ipos1") + F.col("need"), F.size("words")) - 1)
    wanted = starts.join(_sized(item, n_windows), "item_key").select(*starts.columns, "words", F.explode(around).alias("ipos"))
    wanted = wanted.select(*starts.columns, "ipos", F.get("words", F.col("ipos")).alias("term"), (F.col("begin1") + F.col("ipos")).alias("place"))
    wanted = wanted.withColumn("cell", F.explode(_cells(F.col("place"), slop)))
    found = wanted.join(lists, ["doc", "text_key", "term", "cell"]).where(F.abs(F.col("pos") - F.col("place")) <= slop)
    # at most 2 * width - 1 places of the item each
    found = found.groupBy(*starts.columns).agg(F.collect_set("ipos").alias("near"), F.collect_set(F.when(F.col("pos") == F.col("place"), F.col("ipos"))).alias("straight"))

    held = lambda places: F.size(F.filter(places, lambda p: (p >= F.col("i")) & (p < F.col("i") + F.col("need"))))
    judged = found.join(_sized(windows.select("item_key", "ipos1", "i", "need", F.col("others.ipos").alias("others")), n_windows), ["item_key", "ipos1"]).withColumn("exact", held("straight") == F.col("need"))
    if exact:
        judged = judged.where("exact")
    else:
        judged = judged.where((held("near") >= F.col("need") - _lacking()) & F.arrays_overlap("near", "others"))
    first = F.col("begin1") + F.col("i")
    return judged.select("doc", "text_key", "item_key", first.alias("first"), (first + F.col("need") - 1).alias("last"), "exact").distinct()


def _index_for(docs: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tested = words.select(F.explode("words").alias("term")).distinct()
    index = build_index(docs, tested if tested.count() <= BROADCAST_ROWS else None, id_col, text_col)
    return stored(index.sortWithinPartitions("term", "doc", "pos"))


def matches(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index's rows of documents, and what :func:`search` finds in it, with the ``item_id``."""
    words = stored(item_terms(items, item_col, item_text_col))
    index = _index_for(docs, words, id_col, text_col)
    found = search(index, words, width, slop).join(words.select("item_key", "item_id"), "item_key").drop("item_key")
    return index.where("term is null").select("doc_id", "doc", "text_key", F.col("pos").alias("n_words")), found


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_hit, n_items, items, contaminated, n_near``.

    ``items`` holds the ids of the items with exact matches as strings, sorted as strings;
    ``n_near`` counts the items with proximity matches, exact ones among them.
    """
    rows, found = matches(docs, items, width, slop, id_col, text_col, item_col, item_text_col)
    per = Window.partitionBy("doc", "text_key").orderBy("first", "last")
    # exact windows in order of their start: each adds what lies beyond the furthest end so far
    last = F.when(F.col("exact"), F.col("last"))
    seen = F.coalesce(F.max(last).over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    found = found.withColumn("fresh", F.when(F.col("exact"), F.greatest(F.col("last") - F.greatest(F.col("first") - 1, seen), F.lit(0))))
    exact_item = F.when(F.col("exact"), F.col("item_id").cast("string"))
    found = found.groupBy("doc", "text_key").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(exact_item)).alias("items"), F.countDistinct("item_id").alias("n_near"))
    joined = rows.join(found, ["doc", "text_key"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` without an exact match; null and wordless texts stay."""
    hit = matches(docs, items, width, None, id_col, text_col, item_col, item_text_col)[1].select("doc", "text_key").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return packed(docs, doc=F.xxhash64(F.col(id_col), text), text_key=F.xxhash64(text)).join(hit, ["doc", "text_key"], "left_anti").select("row.*")
