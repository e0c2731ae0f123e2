"""Product analyses over lines enriched with product masters (``features.product_lines``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.bands import band
from tillsight.functions.ranking import running_total
from tillsight.functions.distinct import with_distinct
from tillsight.functions.semantics import exact_sum, mean, ratio, ratio_or_zero, tally_or_zero, total_or_zero, whole_sum
from tillsight.operators.features import exclusions, is_unknown_product
from tillsight.session import stage

PRODUCT_KEYS = ("product_id", "product_name", "category", "sub_category")


def known_products(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_unknown_product())


def unknown_product_split(lines: DataFrame) -> DataFrame:
    return exclusions(lines, is_unknown_product())


def sums(*columns: str) -> list[Column]:
    """Exact totals under the columns' own names."""
    return [total_or_zero(F.col(c)).alias(c) for c in columns]


def units(*pairs: tuple[str, str]) -> list[Column]:
    return [F.coalesce(whole_sum(F.col(source)), F.lit(0)).alias(name) for source, name in pairs]


SIGNED_UNITS = ("signed_quantity", "quantity")
SOLD = ("units_sold", "units_sold")
RETURNED = ("units_returned", "units_returned")


def orders() -> Column:
    return F.countDistinct("invoice_id").alias("orders")


def with_margin(summary: DataFrame) -> DataFrame:
    return summary.withColumn("profit_margin", ratio(F.col("gross_profit"), F.col("revenue")))


def with_return_rate(summary: DataFrame) -> DataFrame:
    handled = F.col("units_sold") + F.col("units_returned")
    return summary.withColumn("return_rate", ratio(F.col("units_returned"), handled))


def product_summary(lines: DataFrame) -> DataFrame:
    """Measures of every known product."""
    summary = known_products(lines).groupBy(*PRODUCT_KEYS).agg(
        *sums("revenue", "gross_sales", "gross_profit"),
        total_or_zero(F.col("cost_impact")).alias("cost"),
        *units(SIGNED_UNITS, SOLD, RETURNED),
        orders(),
        mean(F.col("unit_price")).alias("avg_unit_price"),
        mean(F.col("discount")).alias("avg_discount"),
        mean(F.col("production_cost")).alias("production_cost"),
        tally_or_zero(F.col("is_return")).alias("return_rows"),
    )
    return with_return_rate(with_margin(summary))


def product_ranking(lines: DataFrame) -> DataFrame:
    return product_summary(lines).orderBy(F.desc("revenue"), *PRODUCT_KEYS)


def product_overview(lines: DataFrame) -> DataFrame:
    """Known-product totals beside what the unknown-product filter leaves out."""
    unknown = is_unknown_product()
    unnamed = F.col("product_name") == "Unknown Product"
    per_product = lines.groupBy("product_id", unknown.alias("unknown"), unnamed.alias("unnamed")).agg(
        F.count("*").alias("rows"),
        exact_sum(F.col("revenue")).alias("revenue"),
        exact_sum(F.col("gross_profit")).alias("gross_profit"),
        whole_sum(F.col("units_sold")).alias("units_sold"),
    )
    known = ~F.col("unknown")

    def amount(condition, c):
        return F.coalesce(F.sum(F.when(condition, F.col(c))).cast("double"), F.lit(0.0))

    overview = per_product.agg(
        F.countDistinct(F.when(known, F.col("product_id"))).alias("active_products"),
        F.countDistinct(F.when(F.col("unnamed"), F.col("product_id"))).alias("products_missing_master"),
        F.coalesce(F.sum(F.when(F.col("unknown"), F.col("rows"))), F.lit(0)).alias("unknown_product_rows"),
        amount(F.col("unknown"), "revenue").alias("unknown_product_revenue"),
        amount(known, "revenue").alias("revenue"),
        amount(known, "gross_profit").alias("gross_profit"),
        F.coalesce(whole_sum(F.when(known, F.col("units_sold"))), F.lit(0)).alias("units_sold"),
    )
    return overview.withColumn("gross_margin", ratio_or_zero(F.col("gross_profit"), F.col("revenue")))


def top(summary: DataFrame, n: int, measure: Column, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """First ``n`` rows by a measure, ties in key order."""
    return summary.orderBy(measure, *keys).limit(n).select(*keys, *columns)


def top_products_by_revenue(lines: DataFrame, n: int = 10) -> DataFrame:
    return top(product_summary(lines), n, F.desc("revenue"), PRODUCT_KEYS, ("revenue", "quantity", "gross_profit", "profit_margin"))


def top_products_by_profit(lines: DataFrame, n: int = 10) -> DataFrame:
    return top(product_summary(lines), n, F.desc("gross_profit"), PRODUCT_KEYS, ("revenue", "gross_profit", "profit_margin"))


def bottom_products_by_profit(lines: DataFrame, n: int = 10) -> DataFrame:
    columns = ("revenue", "gross_profit", "profit_margin", "return_rate")
    return top(product_summary(lines), n, F.asc("gross_profit"), PRODUCT_KEYS, columns)


def category_performance(lines: DataFrame) -> DataFrame:
    measures = [*sums("revenue"), *units(SIGNED_UNITS, SOLD), *sums("gross_profit"), mean(F.col("discount")).alias("avg_discount"), *units(RETURNED)]
    summary = with_distinct(known_products(lines), ["category"], measures, {"orders": "invoice_id", "products": "product_id"})
    return with_return_rate(with_margin(summary))


def top_sub_categories(lines: DataFrame, n: int = 15) -> DataFrame:
    measures = [*sums("revenue"), *units(SIGNED_UNITS), *sums("gross_profit")]
    counts = {"orders": "invoice_id", "products": "product_id"}
    summary = with_distinct(known_products(lines), ["category", "sub_category"], measures, counts)
    columns = ("revenue", "quantity", "gross_profit", "orders", "products", "profit_margin")
    return top(with_margin(summary), n, F.desc("revenue"), ("category", "sub_category"), columns)


def top_returned_products(lines: DataFrame, n: int = 10) -> DataFrame:
    returned = product_summary(lines).filter(F.col("units_returned") > 0)
    columns = ("units_sold", "units_returned", "return_rate", "revenue")
    return top(returned, n, F.desc_nulls_last("return_rate"), PRODUCT_KEYS, columns)


def discount_by_category(lines: DataFrame) -> DataFrame:
    summary = known_products(lines).groupBy("category").agg(
        mean(F.col("discount")).alias("avg_discount"), *sums("revenue", "gross_profit")
    )
    return with_margin(summary)


def _by_variant(lines: DataFrame, variant: str) -> DataFrame:
    return known_products(lines).groupBy(variant).agg(*sums("revenue"), *units(SIGNED_UNITS), *sums("gross_profit"))


def top_colors(lines: DataFrame, n: int = 10) -> DataFrame:
    return top(_by_variant(lines, "color"), n, F.desc("revenue"), ("color",), ("revenue", "quantity", "gross_profit"))


def size_performance(lines: DataFrame) -> DataFrame:
    return _by_variant(lines, "size")


def abc_classes(lines: DataFrame) -> DataFrame:
    """Cumulative revenue share by falling revenue, and its A/B/C class.

    Loss-making products can push the share above 1, where the class is NULL.
    """
    summary = stage(
        product_summary(lines).select(*PRODUCT_KEYS, "revenue", "gross_profit", "profit_margin"), "product_revenue"
    )
    revenue = F.col("revenue").cast("decimal(30,6)")
    ranked = running_total(summary, [F.desc("revenue"), *[F.asc(k) for k in PRODUCT_KEYS]], revenue, "cumulative")
    whole = summary.agg(F.sum(revenue).cast("double").alias("t")).scalar()
    return (
        ranked.withColumn("_total", whole)
        .withColumns({
            "revenue_share": ratio(F.col("revenue"), F.col("_total")),
            "cumulative_revenue_share": ratio(F.col("cumulative"), F.col("_total")),
        })
        .withColumn("abc_class", band(F.col("cumulative_revenue_share"), s.ABC_BANDS, include_lowest=True))
        .drop("cumulative", "_total")
    )


def abc_summary(lines: DataFrame) -> DataFrame:
    classed = abc_classes(lines)
    whole = exact_sum(F.col("revenue")).cast("double")
    per_class = classed.filter(F.col("abc_class").isNotNull()).groupBy("abc_class").agg(
        F.countDistinct("product_id").alias("products"),
        *sums("revenue", "gross_profit"),
        mean(F.col("profit_margin")).alias("avg_margin"),
    )
    return per_class.withColumn("revenue_share", ratio(F.col("revenue"), classed.agg(whole.alias("t")).scalar()))


def monthly_top_categories(lines: DataFrame, n: int = 5) -> DataFrame:
    """Monthly revenue of the ``n`` best-selling categories."""
    monthly = known_products(lines).groupBy("month", "category").agg(exact_sum(F.col("revenue")).alias("revenue"))
    best = (
        monthly.groupBy("category").agg(F.sum("revenue").alias("r")).orderBy(F.desc("r"), "category").limit(n).select("category")
    )
    return (
        monthly.join(F.broadcast(best), "category", "left_semi")
        .select("month", "category", F.col("revenue").cast("double").alias("revenue"))
        .orderBy("month", "category")
    )
