"""Exact distinct counts beside other aggregates, without multiplying the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Distinct (keys, value) of one column: a mergeable set per key, which coarser keys are counted from as well.

    Partial aggregation drops repeats before the exchange, and the exchange spreads the values of a hot key.
    """
    return rows.select(*keys, column).distinct()


def counted(members: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Number of non-NULL values per key of a set of ``pairs``."""
    return members.groupBy(*keys).agg(F.count(column).alias(name))


def with_distinct(rows: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], counts: dict[str, str]) -> DataFrame:
    """``rows.groupBy(keys).agg(aggregates)`` and exact distinct counts (output name: column); keys have no NULL.

    Several ``countDistinct`` in one aggregation make an ``Expand`` that copies every row, with all its columns, once
    for each of them. Here each count takes a pass over its own two columns, and all results meet on the keys they are grouped
    by.
    """
    result = rows.groupBy(*keys).agg(*aggregates)
    for name, column in counts.items():
        result = result.join(counted(pairs(rows, keys, column), keys, column, name), list(keys))
    return result
