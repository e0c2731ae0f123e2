"""Right-closed banding of numeric columns, by fixed edges or by quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.selection import quantiles


def band(value: Column, bands: Sequence[tuple], include_lowest: bool = False) -> Column:
    """Label of the ``(low, high]`` band holding ``value``; NULL outside all bands."""
    label = None
    for position, (low, high, name) in enumerate(bands):
        above = value >= low if include_lowest and position == 0 else value > low
        inside = above if high is None else above & (value <= high)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


def band_order(label: Column, labels: Sequence[str]) -> Column:
    """1-based position of a label in its ordered list."""
    position = F.array_position(F.array(*[F.lit(name) for name in labels]), label)
    return F.when(label.isNotNull(), position.cast("int"))


def quartile_edges(df: DataFrame, value: str) -> DataFrame:
    """One row ``edges = [min, q1, median, q3, max]`` of a numeric column."""
    measured = df.select(F.lit("value").alias("metric"), F.col(value).cast("double").alias("value"))
    return quantiles(measured, (0.0, 0.25, 0.5, 0.75, 1.0)).select(F.col("quantiles").alias("edges"))


def quartile_band(df: DataFrame, value: str, labels: Sequence[str], output: str, edges: DataFrame | None = None) -> DataFrame:
    """Append the quartile label of ``value``.

    Tied quartile edges fall back to four equal widths over the value range, and
    a constant column gets the second label. The edges are one row, read as a
    scalar subquery, so the banded rows are neither joined nor shuffled.
    """
    edges = quartile_edges(df, value) if edges is None else edges
    e = F.col("_edges")
    low, high = e[0], e[4]
    width = (high - low) / F.lit(4.0)
    tied = F.size(F.array_distinct(e)) < 5
    cuts = [F.when(tied, low + width * F.lit(float(i))).otherwise(e[i]) for i in (1, 2, 3)]
    x = F.col(value)
    label = (
        F.when(x.isNull(), None)
        .when(low == high, labels[1])
        .when(x <= cuts[0], labels[0])
        .when(x <= cuts[1], labels[1])
        .when(x <= cuts[2], labels[2])
        .otherwise(labels[3])
    )
    return df.withColumn("_edges", edges.select("edges").scalar()).withColumn(output, label).drop("_edges")
