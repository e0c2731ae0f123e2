"""Picking the rows of a large table whose key is among others, without moving most of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 6  # a word has 1 << WORD bits
FEW = 1 << 18  # words for some millions of keys, beyond which they let nearly all rows pass
MANY = 1 << 20  # words for some tens of millions; what is broadcast has as many rows at most


def _place(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size << WORD))


def _bit(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")


def key_words(others: DataFrame, key: str, size: int) -> DataFrame:
    """A bit for each hash of a key, in words of 64."""
    places = others.filter(F.col(key).isNotNull()).select(_place(F.col(key), size).alias("_place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("_place")))
    return places.groupBy(F.shiftright("_place", WORD).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def likely(rows: DataFrame, key: str, words: DataFrame, size: int) -> DataFrame:
    """All rows whose key has its bit in ``words``, and no others but those that share one; the words are broadcast."""
    place = F.col("_place")
    placed = rows.withColumn("_place", _place(F.col(key), size)).withColumn("_word", F.shiftright(place, WORD))
    kept = placed.join(F.broadcast(words), "_word").filter(F.call_function("bit_get", F.col("_bits"), _bit(place)) == 1)
    return kept.select(*rows.columns)


def among(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Semi-join of ``rows`` with the keys of ``others``; most rows that match nothing are dropped before they are exchanged.

    The last join is an inner one with distinct keys: a semi-join would be pushed below the filter.
    """
    wanted = others.select(key)
    return likely(rows, key, key_words(wanted, key, FEW), FEW).join(wanted.distinct(), key).select(*rows.columns)
