"""Corpus preparation: stages in order, each over all that its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.

1. Quality: documents that the attention classifier scores below ``MIN_SCORE`` go.
2. Near-duplicates (five-word shingles, similarity 0.8): one document of each group stays,
   that with the smallest id.
3. Decontamination: documents that hold ten consecutive words of a benchmark item go.
4. Secrets: every reported span is replaced by its kind in brackets; no document goes.
5. Packing: token pieces in sequences of ``WINDOW`` tokens.

Null, empty and very long texts, repeated rows and empty tables pass through every
stage as the operators define it: null and empty texts are scored as they are, link
with nothing, hold no benchmark words and no secrets, and pack as one end token;
rows alike in id and text leave stage 2 once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import classifier, decontaminate, neardup, packing, secrets
from lumengraph.llm.common import stored, table

MIN_SCORE, WINDOW = 0.3, 1024
TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model, MIN_SCORE)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), WINDOW)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", redaction),
    ("packing", pack),
]

#: The classifier, the near-duplicate search and the tokeniser can't be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
