"""Exact deduplication with the heavy hitters split off, in DataFrame expressions only.

Frequent digests come from a mergeable Misra-Gries sketch (``approx_top_k``) of fixed size.
Their winners are then counted exactly, broadcast (at most ``TOP`` rows) and applied where the
rows lie, so copies of a hot text are never shuffled. What is left has no digest that holds
more than about a ``1/TRACKED`` share of all rows and goes through an ordinary exchange.

Defined results: a NULL text equals the empty text; the row with the largest ``doc_id`` stays,
a NULL id being the smallest; of repeated rows with the same id and text exactly one stays;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.texts import ascii_lower, unused
from tillsight.session import stage

TRACKED = 4096
TOP = 1024


def digest(docs: DataFrame):
    """SHA-256, in lowercase hex, of the text with A-Z lower-cased."""
    return F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))).cast("binary"), 256)


def frequent(digests: DataFrame, column: str, least: int = 1) -> DataFrame:
    """Candidates for frequent values of ``column``, at most ``TOP`` rows, of about ``least`` rows each or more."""
    found = digests.agg(F.expr(f"approx_top_k(`{column}`, {TOP}, {TRACKED})").alias("found"))
    return found.select(F.explode("found").alias("found")).where(F.col("found.count") >= least).select(F.col("found.item").alias(column))


def _winners(rows: DataFrame, column: str) -> DataFrame:
    """Exact size and winner of every frequent digest; ``rows`` has the digest, ``doc_id`` and ``row``."""
    candidates = F.broadcast(frequent(rows, column))
    return rows.join(candidates, column, "left_semi").groupBy(column).agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("winner")
    )


def duplicate_labels(docs: DataFrame) -> DataFrame:
    """One row per document: who of its group of equal texts stays.

    Columns ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    """
    rows = stage(
        docs.select("doc_id", digest(docs).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    labelled = rows.join(F.broadcast(_winners(rows, "text_sha256")), "text_sha256", "left")
    heavy = labelled.where(F.col("winner").isNotNull())
    group = Window.partitionBy("text_sha256")
    light = labelled.where(F.col("winner").isNull()).select(
        "text_sha256", "doc_id", "row",
        F.count(F.lit(1)).over(group).alias("group_size"), F.max(F.struct("doc_id", "row")).over(group).alias("winner"),
    )
    return heavy.select(light.columns).unionByName(light).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"), "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Losers of frequent groups are dropped in place by the broadcast winners; the other rows
    meet by digest, where no group is large.
    """
    key, row_name, best = unused(docs, "_exact_digest"), unused(docs, "_exact_row"), unused(docs, "_exact_winner")
    keyed = docs.withColumn(key, digest(docs))
    narrow = keyed.select(F.col(key), "doc_id", F.lit(0).alias("row"))
    winners = _winners(narrow, key).select(key, F.col("winner.doc_id").alias(best), F.lit(True).alias(f"{best}_found"))
    left = keyed.join(F.broadcast(winners), key, "left")
    left = left.where(F.col(f"{best}_found").isNull() | F.col("doc_id").eqNullSafe(F.col(best)))
    order = Window.partitionBy(key).orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    return left.withColumn(row_name, F.row_number().over(order)).where(F.col(row_name) == 1).select(docs.columns)
