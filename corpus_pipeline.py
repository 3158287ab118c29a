"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the quality classifier rejects go;
2. near-duplicates: one document of each SimHash group stays;
3. passages: words of passages that an earlier document holds go;
4. secrets: every secret found is replaced by a mark;
5. packing: what is left becomes sequences of at most 4096 tokens.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; the last returns
a row per piece of a document with its sequence and place in it.  A text without
a word (NULL, empty, white space) scores 0, so stage 1 drops it; given to a
later stage it passes like an empty one, and a NULL text stays NULL.  The tables
between the stages go once the next stage's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm import packing, passages, quality, secrets, simhash
from lodging.llm.common import discard, stage, table


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows a text that was changed."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(passages.without_repeats(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.word_bpe())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No SQL states a fitted classifier or the tokenizer; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet before the next one reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs, path = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
