"""Intermediate tables that a later join reads without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from groundwell.session import fresh_folder


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key`` and read it back, to be joined by ``key`` as it lies.

    There are as many buckets as a shuffle has partitions, so that the other side of a join comes to them.
    """
    spark = df.sparkSession
    name = f"groundwell_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option(
        "path", fresh_folder(spark, label)).format("parquet").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; the files and their buckets stay
    return written
