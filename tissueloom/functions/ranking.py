"""Numbers of a global order, without a task that orders all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.staging import stored


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` cut into ranges of an order, with the range's number ``_part``; stored, so that the cut is made once."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, *order: str | Column, out: str = "n") -> DataFrame:
    """``df`` with each row's place in the order, from 1: within its range, after the counts of the ranges before it.

    Ties are numbered in any order. The ranges' counts are a row a range.
    """
    cut = ranged(df, *order)
    counts = cut.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = cut.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_k")).drop("_before", "_k", "_part")


def suffix_min(df: DataFrame, place: str, value: Column, out: str) -> DataFrame:
    """``df`` with the least ``value`` of each row and all rows of a higher ``place``; nulls count as nothing."""
    cut = ranged(df.withColumn(out, value), place)
    least = cut.groupBy("_part").agg(F.min(out).alias("_m"))
    later = least.select("_part", F.min("_m").over(W.orderBy("_part").rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    own = F.min(out).over(W.partitionBy("_part").orderBy(F.desc(place)).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn(out, own).join(F.broadcast(later), "_part").withColumn(out, F.least(out, "_later")).drop("_later", "_part")
