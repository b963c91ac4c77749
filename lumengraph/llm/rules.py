"""Quality rules combined by weak supervision.

Each rule looks at a document's counts and votes good, votes bad or abstains.
Nothing says how far a rule can be trusted: expectation-maximisation estimates
from all documents how often each rule is right on good and on bad documents,
taking the unknown quality as the hidden variable, and a document is kept when
its posterior probability of being good reaches ``min_posterior``.

Votes enter the estimation only as counts of vote patterns: at most
3 ** len(RULES) rows however large the corpus is.  Counts are computed once and
written to the checkpoint folder; the verdict is an expression over them.

Everything on the rows is DataFrame expressions: no Python runs on them.

Defined results: a null text has no words, a document of fewer than 50 words
fails the base rules, a null doc_id is kept, repeated rows give one row each, an
empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

GOOD, BAD = 1, 2
#: Share of the documents that the belief about rules counts for; the rest of the evidence is theirs.
WEIGHT = 0.1
SYMBOLS = "#*$%&|<>"


def _repeat_words(ordered: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``ordered``: the windows by hash, then place."""
    same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
    again = F.filter(ordered, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, i: Column) -> Column:
        return F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"))

    return F.aggregate(at, begin, step, lambda s: s["n"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each document: the base counts of the rules and those that only the votes use."""
    only = lambda text, kept: F.regexp_replace(text, f"[^{kept}]+", "")
    many = lambda text, kept: F.char_length(only(text, kept)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # two passes over the characters: the marks that are counted, of which there are few, and the white space
    rows = rows.withColumn("marks", only(F.col("text"), SYMBOLS + "!?A-Z"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD))))
    hashes = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("hashes", hashes)
    # only documents in which a window recurs are sorted
    recurs = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = F.when(recurs, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("ordered", ordered)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - many(F.col("text"), r"\x20\x09-\x0D")).cast("long").alias("word_chars"),
        many(F.col("marks"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("ordered")).alias("n_repeat_words"),
        many(F.col("marks"), "A-Z").alias("n_upper"),
        many(F.col("marks"), "!?").alias("n_calls"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _high_is_bad(value: Column, good: float, bad: float) -> Column:
    return F.when(value > bad, BAD).when(value <= good, GOOD).otherwise(0)


#: Name -> vote (0 abstains).  Thresholds are parameters of the rules, not fitted.  No two rules read the same fault:
#: the estimation takes them as independent, given the quality.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: F.when(F.col("n_words") < 50, BAD).when(F.col("n_words") >= 100, GOOD).otherwise(0),
    "word_length": lambda: F.when(~_ratio("word_chars", "n_words").between(3, 11), BAD).when(_ratio("word_chars", "n_words").between(3.5, 9), GOOD).otherwise(0),
    "symbols": lambda: _high_is_bad(_ratio("n_symbols", "n_words"), 0.05, 0.2),
    "repeats": lambda: _high_is_bad(_ratio("n_repeat_words", "n_words"), 0.2, 0.5),
    "lines": lambda: F.when(F.col("n_lines") < 2, 0).otherwise(_high_is_bad(_ratio("n_dup_lines", "n_lines"), 0.1, 0.4)),
    "capitals": lambda: _high_is_bad(_ratio("n_upper", "word_chars"), 0.1, 0.4),
    "calls": lambda: _high_is_bad(_ratio("n_calls", "n_words"), 0.05, 0.3),
    "vocabulary": lambda: F.when(F.col("n_words") < 50, 0).when(_ratio("n_distinct", "n_words") < 0.1, BAD).when(F.col("n_distinct") >= 40, GOOD).otherwise(0),
}


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, belief: tuple[float, float] = (0.99, 0.6), weight: float = WEIGHT) -> tuple[float, list[tuple[float, float]]]:
    """(prior of good, and for each rule its chance to vote GOOD on good and on bad documents, given that it votes).

    ``belief`` is what is held of each rule beforehand: it seldom votes BAD on a
    good document and misses most bad ones, whose fault is another.  It counts
    as ``weight`` times the documents; without it, faults that seldom come
    together would be taken for mistakes of their rules.
    """
    total = sum(n for _, n in patterns)
    prior, rates = 0.8, [belief] * len(RULES)
    for _ in range(rounds if total else 0):
        posterior = [1 / (1 + math.exp(-max(-700.0, min(700.0, _log_odds(prior, rates, votes))))) for votes, _ in patterns]
        good = sum(p * n for p, (_, n) in zip(posterior, patterns))
        prior = (good + 1) / (total + 2)
        extra, rates = weight * total, []
        for j in range(len(RULES)):
            sums = {(v, c): 0.0 for v in (GOOD, BAD) for c in (True, False)}
            for p, (votes, n) in zip(posterior, patterns):
                if votes[j]:
                    sums[votes[j], True] += p * n
                    sums[votes[j], False] += (1 - p) * n
            rates.append(tuple((sums[GOOD, c] + extra * share * b) / (sums[GOOD, c] + sums[BAD, c] + extra * share) for c, b, share in zip((True, False), belief, (prior, 1 - prior))))
    return prior, rates


def _weights(prior: float, rates: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float, float]]]:
    """Base log-odds and each rule's addition by vote: abstained, good, bad."""
    return math.log(prior / (1 - prior)), [(0.0, math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in rates]


def _log_odds(prior: float, rates: list[tuple[float, float]], votes: tuple[int, ...]) -> float:
    base, weights = _weights(prior, rates)
    return base + sum(w[v] for w, v in zip(weights, votes))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, ``posterior`` and ``kept`` of each document."""
    rows = cut(measure(docs, id_col, text_col))
    names = [f"vote_{k}" for k in RULES]
    rows = rows.select("*", *[rule().alias(n) for n, rule in zip(names, RULES.values())])
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in rows.groupBy(*names).count().collect()]
    base, weights = _weights(*estimate(sorted(patterns)))
    odds = F.lit(base)
    for name, w in zip(names, weights):
        odds = odds + F.when(F.col(name) == GOOD, w[GOOD]).when(F.col(name) == BAD, w[BAD]).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = rows.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))
