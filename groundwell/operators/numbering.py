"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.session import settle


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Number the rows of each key from 1 without gathering a key in one task.

    ``bucket`` must rise with the first order column (a day of a timestamp, for
    one).  Rows are numbered inside (key, bucket); the counts of the buckets
    before give the offset.  Only bucket counts of a key meet in one place.
    """
    cut = rows.withColumn("__bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (
        cut.withColumn("__i", F.row_number().over(inside)).join(offsets, [*keys, "__bucket"])
        .withColumn(name, F.col("__i") + F.col("__offset")).drop("__i", "__offset", "__bucket")
    )


def numbered_by_range(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 1 by ``order`` (nulls first), whatever share of all rows a key or a tie has.

    Rows are dealt out by ranges of (key, order); a key, and equal rows too, may lie in many ranges.  A row's number
    is its place in its range, less the place of the key's first row there, plus the key's rows in the ranges before.
    Only one count per key and range meets in one place.  Keys must not be null.
    """
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys, *order, "__tie").sortWithinPartitions(*keys, *order, "__tie")
    # written, so that the ranges stay as they are
    placed = settle(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))  # the upper bits are the partition
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1)
        .drop("__first", "__n")
    )
    return (
        placed.join(shifts, [*keys, "__range"]).withColumn(name, F.col("__at") + F.col("__shift"))
        .drop("__at", "__range", "__shift")
    )
