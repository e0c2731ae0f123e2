"""Discount and campaign analyses over ``features.discount_lines``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.semantics import mean, ratio, tally_or_zero, total_or_zero
from tillsight.operators.product import PRODUCT_KEYS, SIGNED_UNITS, orders, sums, top, units, with_margin
from tillsight.operators.sales import LABELS, correlations
from tillsight.operators.features import segment_order

CORRELATED = ("discount", "campaign_discount", "revenue", "gross_profit", "quantity")


def discount_overview(lines: DataFrame) -> DataFrame:
    revenue = F.col("revenue")
    has, listed = F.col("has_discount"), F.col("is_campaign_period")

    def part(condition: Column) -> Column:
        return total_or_zero(F.when(condition, revenue))

    return lines.agg(
        total_or_zero(revenue).alias("total_revenue"),
        total_or_zero(F.col("gross_profit")).alias("total_profit"),
        part(has).alias("discounted_revenue"),
        part(~has).alias("no_discount_revenue"),
        part(listed).alias("campaign_revenue"),
        part(~listed).alias("non_campaign_revenue"),
        tally_or_zero(listed).alias("campaign_rows"),
        tally_or_zero(has).alias("discounted_rows"),
    )


def _core(discount_name: str) -> list[Column]:
    return [
        F.count("*").alias("rows"), orders(), *sums("revenue", "gross_profit"), *units(SIGNED_UNITS),
        mean(F.col("discount")).alias(discount_name),
        tally_or_zero(F.col("is_return")).alias("return_rows"),
    ]


def _with_rates(summary: DataFrame) -> DataFrame:
    return with_margin(summary).withColumn("return_row_rate", ratio(F.col("return_rows"), F.col("rows")))


def discount_status_summary(lines: DataFrame) -> DataFrame:
    return _with_rates(lines.groupBy("discount_status").agg(
        *_core("avg_discount"), mean(F.col("campaign_discount")).alias("avg_campaign_discount")
    ))


def discount_group_summary(lines: DataFrame) -> DataFrame:
    summary = _with_rates(lines.groupBy("discount_group").agg(*_core("avg_discount")))
    return segment_order(summary, "discount_group", LABELS["discount_group"])


def _with_gap(summary: DataFrame) -> DataFrame:
    return summary.withColumn("discount_gap", F.col("avg_actual_discount") - F.col("campaign_discount"))


def in_campaign(lines: DataFrame) -> DataFrame:
    return lines.filter("is_campaign_period")


def campaign_summary(lines: DataFrame) -> DataFrame:
    named = in_campaign(lines).filter(F.col("campaign_description").isNotNull())
    summary = named.groupBy("campaign_description").agg(
        *_core("avg_actual_discount"), mean(F.col("campaign_discount")).alias("campaign_discount")
    )
    return _with_gap(_with_rates(summary))


def category_by_status(lines: DataFrame) -> DataFrame:
    return with_margin(lines.groupBy("category", "discount_status").agg(
        *sums("revenue", "gross_profit"), *units(SIGNED_UNITS), orders(), mean(F.col("discount")).alias("avg_discount")
    ))


def top_campaign_categories(lines: DataFrame, n: int = 20) -> DataFrame:
    keys = ("campaign_description", "category", "sub_category")
    summary = _with_gap(with_margin(in_campaign(lines).groupBy(*keys).agg(
        *sums("revenue", "gross_profit"), *units(SIGNED_UNITS), orders(),
        mean(F.col("discount")).alias("avg_actual_discount"),
        mean(F.col("campaign_discount")).alias("campaign_discount"),
    )))
    return top(summary, n, F.desc("revenue"), keys, tuple(c for c in summary.columns if c not in keys))


def monthly_status_trend(lines: DataFrame) -> DataFrame:
    return lines.groupBy("month", "discount_status").agg(*sums("revenue", "gross_profit"), orders()).orderBy("month", "discount_status")


def discount_correlation(lines: DataFrame) -> DataFrame:
    return correlations(lines, CORRELATED)


def high_discount_low_margin(lines: DataFrame, n: int = 20, min_discount: float = 0.3, max_margin: float = 0.4) -> DataFrame:
    """Products sold at a high average discount for a low margin, steepest discount first."""
    summary = with_margin(lines.filter("has_discount").groupBy(*PRODUCT_KEYS).agg(
        *sums("revenue", "gross_profit"), *units(SIGNED_UNITS), mean(F.col("discount")).alias("avg_discount"), orders()
    ))
    risky = summary.filter((F.col("avg_discount") >= min_discount) & (F.col("profit_margin") < max_margin))
    return risky.orderBy(F.desc("avg_discount"), F.asc("profit_margin"), *PRODUCT_KEYS).limit(n)
