"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.skew import join_back
from tillsight.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node onto the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    moved = join_back(both, low, ["u"]).where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.least("u", "low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours onto the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = join_back(down, low, ["u"]).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Each node of ``edges`` (u, v), except the smallest ones, with the smallest node it is joined to.

    Columns ``node`` and ``component``. Every round is written to shared storage; the number of rounds
    grows with the logarithm of the longest path. Only a row count and a checksum reach the driver.
    """
    edges = stage(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    before, now = None, _state(edges)
    while now != before:
        large = _large_star(edges).where(F.col("u") != F.col("v")).distinct()
        edges = stage(_small_star(large).where(F.col("u") != F.col("v")).distinct(), "edges")
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
