"""Joining summaries back to rows when one key may hold a large share of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 16  # values of the hash; a whole one would be eight bytes that do not compress in every row that moves


def join_back(rows: DataFrame, summary: DataFrame, keys: Sequence[str], spread: str | Sequence[str] | None = None) -> DataFrame:
    """Left join a one-row-per-key summary to rows.

    Adaptive execution splits a hot key's rows over many tasks only when both join
    inputs come straight from an exchange. A grouped summary is already partitioned
    on the key and would skip that exchange, so a hash of the key joins the key
    columns: the summary (one row per key) is exchanged again and the split applies.
    Small summaries are still turned into broadcasts by their measured size.

    Rows with a NULL key match nothing; ``spread`` names a column, or several, whose hash
    scatters them over all partitions.
    """
    def place(*columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(PLACES))

    key_hash = place(*keys)
    left_hash = key_hash
    if spread is not None:
        missing = F.lit(False)
        for key in keys:
            missing = missing | F.col(key).isNull()
        left_hash = F.when(missing, place(*([spread] if isinstance(spread, str) else spread))).otherwise(key_hash)
    left = rows.withColumn("_key_hash", left_hash)
    right = summary.withColumn("_key_hash", key_hash)
    return left.join(right, [*keys, "_key_hash"], "left").drop("_key_hash")
