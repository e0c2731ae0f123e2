"""Ranks and running sums without a single-task sort.

Rows are range-partitioned on a complete ordering and written to shared storage
with their slice number. Slice totals (one row per slice) give each slice its
starting position, so every later step works inside slices only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.session import stage


def sliced(df: DataFrame, *order: Column | str) -> DataFrame:
    """Range-partition on ``order`` and pin each row's slice number.

    The ordering must be unique per row, so that no run of ties can be larger
    than a slice. The slice number is stored, not recomputed.
    """
    ranged = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    return stage(ranged, "slices")


def slice_starts(slices: DataFrame, measure: Column) -> DataFrame:
    """Sum of ``measure`` per slice and over all earlier slices (one row per slice)."""
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = slices.groupBy("_slice").agg(F.sum(measure).alias("in_slice"))
    before = F.coalesce(F.sum("in_slice").over(earlier), F.lit(0))
    return per_slice.withColumn("before", before)


def running_total(df: DataFrame, order: Sequence[Column | str], measure: Column, output: str) -> DataFrame:
    """Append the running sum of a decimal ``measure`` in the given complete order."""
    slices = sliced(df, *order)
    starts = slice_starts(slices, measure).select("_slice", "before")
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        slices.withColumn("_inside", F.sum(measure).over(inside))
        .join(F.broadcast(starts), "_slice")
        .withColumn(output, F.col("before") + F.col("_inside"))
        .drop("_slice", "before", "_inside")
    )


def row_numbers(df: DataFrame, group: str, order: str) -> DataFrame:
    """Append ``row_number`` within ``group`` by ``order`` (unique), safe for huge groups.

    A group spread over several slices is numbered slice by slice and shifted by
    the count in its earlier slices; a group has at most one row per slice there.
    """
    slices = sliced(df, group, order)
    inside = Window.partitionBy("_slice", group).orderBy(order)
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        slices.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.sum("_n").over(earlier))
        .filter(F.col("_shift").isNotNull())
        .select(group, "_slice", "_shift")
    )
    numbered = slices.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(shifts, [group, "_slice"], "left")
        .withColumn("row_number", (F.col("_inside") + F.coalesce("_shift", F.lit(0))).cast("bigint"))
        .drop("_slice", "_inside", "_shift")
    )
