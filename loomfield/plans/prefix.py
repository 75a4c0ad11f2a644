"""Prefix sums within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.plans.shared import broadcast_if_small

#: Rows that one bucket of a group holds on average, at most.
BUCKET_ROWS = 2_000
#: A table of bucket offsets of so many rows at most is broadcast.
MOST_BUCKETS = 200_000


def bits_for(rows: int) -> int:
    """High bits of a uniform hash that leave about BUCKET_ROWS rows or fewer per value."""
    return max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))


def high_bits(key: Column, bits: int) -> Column:
    """The high bits of a non-negative 60-bit key: buckets in the order of the key."""
    return F.shiftright(key, 60 - bits).cast("int")


def prefix_in_groups(df: DataFrame, group: str, bucket: str, order: list[str], value: str, into: str) -> DataFrame:
    """df with the column into: the sum of value over the rows of the same group that come before, by bucket and then order.

    Buckets must ascend in the order wanted; group and bucket must not be null. Each bucket is summed by itself
    and shifted by the sum of its group's earlier buckets. df is read twice, so it should be a stored table.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn(into, F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inside.join(broadcast_if_small(offsets, MOST_BUCKETS), (F.col(group) == F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(into, F.col(into) + F.col("__shift")).drop("__g", "__b", "__shift")
