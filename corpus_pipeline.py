"""From raw documents to token files: a chain of stages, each of which calls one operator of ``groundwell.llm``.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
``docs``; the last returns what the token files hold.  Filters decide by (doc_id, text), so rows that agree in both
share their fate, except that near-dedup keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import documents
from groundwell.llm.decontaminate import contamination
from groundwell.llm.language_id import spoken_rows
from groundwell.llm.mixing import mixed_documents
from groundwell.llm.shingle_dedup import near_duplicates
from groundwell.llm.token_binary import token_files
from groundwell.session import scratch, settle

SHIPPED_KEYS = 100_000  # keys of dropped rows, of 8 bytes each, that are sent to every task


def _key() -> Column:
    """Stands for a row in the operators' results, also where doc_id is null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("doc_id"), F.col("text").cast("string").alias("text"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (doc_id); few keys travel, so that no document has to."""
    gone = settle(dropped.select(F.col("doc_id").alias("gone")).distinct(), "pipeline-dropped", lasting=True)
    gone = F.broadcast(gone) if gone.limit(SHIPPED_KEYS + 1).count() <= SHIPPED_KEYS else gone
    # the row is one column, so that no column of docs meets the key
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key"))
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the models do not reject."""
    return spoken_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are alike to 0.8 or more: the smallest doc_id."""
    return near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that do not hold most of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with scratch(spark):
        return _without(docs, contamination(_keyed(docs), benchmark).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and lists what they hold."""
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix),
          ("tokens", tokens)]
ORACLE_SQL = None  # shingle similarities, tilings and drawn mixes are not SQL; tests/llm/test_pipeline.py has the brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
