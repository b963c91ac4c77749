"""Identifier recipes and text predicates as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a question that never seed a search.
STOPWORDS = (
    "how what why when where which who does did is are was were be can could should would will may might must has have "
    "had the and but not for from with into that this these those there here its their them they about any all some "
    "work works working a an of to in on do"
).split()


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts beyond ASCII are sent to Python, the rest stay where they are."""

    def compose(series: pd.Series) -> pd.Series:
        return series.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    beyond = F.pandas_udf(compose, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text))
    return F.coalesce(beyond, text)


def normalize_id(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, runs of non-word characters and underscores to one underscore, no underscore at the edges, lower case.

    ``ascii_only`` leaves the Unicode step out where the input is known to be ASCII.
    """
    folded = text if ascii_only else nfkc(text)
    return F.lower(F.btrim(F.regexp_replace(folded, r"(?U)(?:[^\w]|_)+", "_"), F.lit("_")))


def make_id(*parts: Column, ascii_only: bool = False) -> Column:
    """Canonical node id of name parts; empty parts drop out."""
    kept = [F.nullif(F.btrim(p, F.lit("_.")), F.lit("")) for p in parts]
    return normalize_id(F.concat_ws("_", *kept), ascii_only)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """The path without its last extension; a leading dot begins a name, not an extension."""
    name = basename(path)
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")
    return F.when(name.isin("", "..", "."), F.lit("")).otherwise(F.concat(F.substring(path, F.lit(1), F.char_length(path) - F.char_length(name)), stem))


def symbol_key(label: Column) -> Column:
    """What two mentions of a symbol share: no call brackets, no leading dots; case counts."""
    trimmed = F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"^[()]+|[()]+$", ""), r"^\.+", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; the underscore separates."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def searchable(words: Column) -> Column:
    """Without tokens of one or two plain letters."""
    return F.filter(words, lambda t: ~t.rlike("^[a-z]{1,2}$"))


def query_terms(question: Column) -> Column:
    """Content words of a question; if there are none, its searchable words."""
    words = searchable(tokens(question))
    content = F.filter(words, lambda t: ~t.isin(STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def line_number(text: Column, offset: Column) -> Column:
    """1 + the line breaks before ``offset`` (characters)."""
    before = F.substring(text, F.lit(1), offset)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def xml_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text
