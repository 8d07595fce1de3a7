"""A training-data pipeline over ``documents``: language, exact and near copies, secrets, packing.

Each stage works on all rows that the stage before kept, written as Parquet and read again in between, so a stage that is
lost with its executors starts from a table; a table is deleted when the one after it is written. All stages but the last
return the columns of ``documents``, whatever their names, and an empty table for an empty one. Of rows that agree in all
columns one stays after the exact copies. Null and repeated ids are rows like others: no text is lost by them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strataquill.llm import exact_dedup, langid, ngram_join, packing, secrets
from strataquill.llm.queries import vocabulary
from strataquill.session import ensure_checkpoint_dir, remove, ship, spread, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts and texts without a letter."""
    ship(spark)
    return langid.keep_known(spread(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays, then the one with the smallest id (nulls last)."""
    return exact_dedup.keep_first(spread(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of at least 0.8 on five-word shingles, the smallest id stays (nulls last);
    null texts and texts without words are linked with nothing and stay."""
    ship(spark)
    return ngram_join.keep_one(spread(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays, null and empty texts as they are."""
    return secrets.redact(spread(docs), words=secrets.vocabulary_words(vocabulary("word_bpe_49k.json")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens; one row per piece, for a null text one of its end id."""
    ship(spark)
    return packing.pack(packing.pieces(spread(docs), vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID and packing can't be said in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
