"""Labelled evaluation examples from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv

EXAMPLE = (
    "struct<id:string,question:string,mode:string,repository_id:string,"
    "expected_files:array<string>,expected_keywords:array<string>,notes:string>"
)


def parse_examples(document: Column) -> Column:
    """Examples of one JSON document: ``{"examples": [...]}`` or a bare list."""
    wrapped = F.from_json(document, f"struct<examples:array<{EXAMPLE}>>")["examples"]
    return F.when(F.ltrim(document).startswith("["), F.from_json(document, f"array<{EXAMPLE}>")).otherwise(wrapped)


def valid_examples(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per usable example; rows without id or question, or with an unknown mode, go."""
    rows = documents.select(F.explode(parse_examples(F.col(column))).alias("e")).select("e.*")
    empty = F.array().cast("array<string>")
    return rows.withColumn("mode", F.coalesce("mode", F.lit("ask"))).where(
        F.col("id").isNotNull() & F.col("question").isNotNull() & F.col("mode").isin(fv.MODES)
    ).select("id", "question", "mode", "repository_id", F.coalesce("expected_files", empty).alias("expected_files"),
             F.coalesce("expected_keywords", empty).alias("expected_keywords"),
             F.coalesce("notes", F.lit("")).alias("notes"))


def load_eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Examples of every JSON file at ``path``; each file is one document."""
    return valid_examples(spark.read.text(path, wholetext=True))
