"""Sales analyses over line items and invoices."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.selection import quantiles
from tillsight.functions.semantics import (
    exact_sum, mean, pearson, ratio_or_zero, round_half_up, tally_or_zero, total_or_zero, whole_sum,
)
from tillsight.operators import features as f
from tillsight.session import stage

DRIVERS = ("revenue", "gross_sales", "quantity", "unit_price", "discount", "discount_amount")
ORDER_METRICS = ("order_revenue", "order_quantity", "unique_products", "line_count")
LABELS = {
    "basket_size_group": tuple(label for _, _, label in s.BASKET_BANDS),
    "discount_group": tuple(label for _, _, label in s.DISCOUNT_BANDS),
    "price_segment": s.PRICE_SEGMENTS,
    "weekday": f.WEEKDAYS,
}


def _per_invoice(lines: DataFrame, *aggregates: Column) -> DataFrame:
    return lines.groupBy("invoice_id").agg(*aggregates)


def sales_overview(lines: DataFrame) -> DataFrame:
    """Headline totals; invoices are pre-summed so orders need no distinct count."""
    per_invoice = _per_invoice(
        lines,
        *[exact_sum(F.col(c)).alias(c) for c in ("revenue", "gross_sales", "discount_amount")],
        whole_sum(F.col("quantity")).alias("quantity"),
        tally_or_zero(F.col("is_return")).alias("returns"),
    )

    def amount(c):
        return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))

    totals = per_invoice.agg(
        amount("revenue").alias("total_revenue"),
        amount("gross_sales").alias("total_gross_sales"),
        amount("discount_amount").alias("total_discount_amount"),
        F.count("*").alias("total_orders"),
        F.coalesce(whole_sum(F.col("quantity")), F.lit(0)).alias("total_units"),
        F.coalesce(F.sum("returns"), F.lit(0)).alias("total_returns"),
    )
    revenue, orders, units = F.col("total_revenue"), F.col("total_orders"), F.col("total_units")
    return totals.withColumns({
        "aov": ratio_or_zero(revenue, orders),
        "avg_revenue_per_unit": ratio_or_zero(revenue, units),
        "avg_items_per_order": ratio_or_zero(units, orders),
    })


def revenue_by(lines: DataFrame, period: str) -> DataFrame:
    return lines.filter(F.col(period).isNotNull()).groupBy(period).agg(total_or_zero(F.col("revenue")).alias("revenue")).orderBy(period)


def monthly_revenue(lines: DataFrame) -> DataFrame:
    return revenue_by(lines, "month")


def quarterly_revenue(lines: DataFrame) -> DataFrame:
    return revenue_by(lines, "quarter")


def correlations(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Long-form correlation matrix from one aggregation over each unordered pair."""
    position = {c: i for i, c in enumerate(columns)}
    pairs = [(x, y) for x, y in product(columns, columns) if position[x] <= position[y]]
    wide = lines.agg(*[
        round_half_up(pearson(F.col(x).cast("double"), F.col(y).cast("double")), 6).alias(f"{x}~{y}") for x, y in pairs
    ])
    cells = []
    for x, y in product(columns, columns):
        name = f"{x}~{y}" if position[x] <= position[y] else f"{y}~{x}"
        cells.append(F.struct(F.lit(x).alias("var_x"), F.lit(y).alias("var_y"), F.col(f"`{name}`").alias("corr")))
    return wide.select(F.inline(F.array(*cells)))


def revenue_driver_correlation(lines: DataFrame) -> DataFrame:
    return correlations(lines, DRIVERS)


def order_statistics(lines: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of four order metrics."""
    invoices = stage(f.invoice_summary(lines).select(*ORDER_METRICS), "order_metrics")
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ORDER_METRICS]
    measured = invoices.select(F.inline(F.array(*cells)))
    moments = measured.groupBy("metric").agg(
        F.count("value").alias("count"),
        round_half_up(mean(F.col("value")), 4).alias("mean"),
        round_half_up(F.stddev_samp("value"), 4).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = F.col("quantiles")
    quartiles = quantiles(measured, (0.25, 0.5, 0.75)).select(
        "metric", *[round_half_up(q[i], 4).alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    )
    return moments.join(quartiles, "metric").select("metric", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def order_revenue_histogram(lines: DataFrame, bins: int = 50) -> DataFrame:
    """Orders per equal-width revenue bin, empty bins included; the last bin is closed."""
    orders = _per_invoice(lines, total_or_zero(F.col("revenue")).alias("order_revenue"))
    span = orders.agg(F.min("order_revenue").alias("low"), F.max("order_revenue").alias("high"))
    flat = F.col("low") == F.col("high")
    span = span.select(F.struct(
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    ).alias("span"))
    place = (F.col("order_revenue") - F.col("span.low")) / (F.col("span.high") - F.col("span.low")) * F.lit(float(bins))
    counted = (
        orders.withColumn("span", span.scalar())
        .groupBy(F.least(F.floor(place), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    width = (F.col("span.high") - F.col("span.low")) / F.lit(float(bins))
    frame = lines.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("span", span.scalar())
    return frame.filter(F.col("span.low").isNotNull()).join(counted, "bin", "left").select(
        (F.col("bin") + 1).alias("bin"),
        round_half_up(F.col("span.low") + width * F.col("bin"), 4).alias("bin_low"),
        round_half_up(F.col("span.low") + width * (F.col("bin") + 1), 4).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("orders"),
    ).orderBy("bin")


def basket_analysis(lines: DataFrame) -> DataFrame:
    invoices = f.basket_groups(f.invoice_summary(lines))
    summary = invoices.groupBy("basket_size_group").agg(
        F.count("*").alias("orders"),
        total_or_zero(F.col("order_revenue")).alias("revenue"),
        mean(F.col("order_revenue")).alias("avg_order_value"),
        mean(F.col("unique_products")).alias("avg_unique_products"),
    )
    return f.segment_order(summary, "basket_size_group", LABELS["basket_size_group"])


def _revenue_quantity_orders() -> list[Column]:
    return [
        total_or_zero(F.col("revenue")).alias("revenue"),
        F.coalesce(whole_sum(F.col("quantity")), F.lit(0)).alias("quantity"),
        F.countDistinct("invoice_id").alias("orders"),
    ]


def weekday_sales(lines: DataFrame) -> DataFrame:
    return lines.groupBy("weekday", "weekday_ord").agg(*_revenue_quantity_orders()).orderBy("weekday_ord")


def weekend_sales(lines: DataFrame) -> DataFrame:
    summary = lines.groupBy("is_weekend").agg(*_revenue_quantity_orders())
    day_type = F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday")
    return summary.select(day_type.alias("day_type"), "revenue", "orders", "quantity")


def price_segment_sales(lines: DataFrame) -> DataFrame:
    """Figures per price quartile of the lines."""
    segmented = f.price_segments(lines)
    summary = segmented.groupBy("price_segment").agg(
        *_revenue_quantity_orders(), mean(F.col("unit_price")).alias("avg_unit_price")
    )
    return f.segment_order(summary, "price_segment", s.PRICE_SEGMENTS)


def return_analysis(lines: DataFrame) -> DataFrame:
    is_return = F.col("is_return")
    per_invoice = _per_invoice(
        lines,
        F.count("*").alias("rows"),
        tally_or_zero(is_return).alias("returns"),
        exact_sum(F.when(is_return, F.col("revenue"))).alias("revenue"),
    )
    summary = per_invoice.agg(
        F.coalesce(F.sum("returns"), F.lit(0)).alias("return_rows"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        tally_or_zero(F.col("returns") > 0).alias("return_orders"),
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum("revenue").cast("double"), F.lit(0.0)).alias("return_revenue"),
    )
    return summary.withColumns({
        "return_row_rate": ratio_or_zero(F.col("return_rows"), F.col("total_rows")),
        "return_order_rate": ratio_or_zero(F.col("return_orders"), F.col("total_orders")),
    })


def sales_insights(lines: DataFrame) -> DataFrame:
    """Totals, best and worst month (earliest on a tie) and three driver correlations."""
    months = monthly_revenue(lines)
    revenue, month = F.col("revenue"), F.col("month")
    peak = F.min(F.struct((-revenue).alias("k"), month, revenue))
    lowest = F.min(F.struct(revenue.alias("k"), month, revenue))
    extremes = months.agg(F.struct(peak.alias("peak"), lowest.alias("lowest")).alias("m"))
    corr = [
        round_half_up(pearson(F.col("revenue"), F.col(c).cast("double")), 6).alias(f"corr_revenue_{c}")
        for c in ("unit_price", "quantity", "discount")
    ]
    return lines.agg(
        total_or_zero(revenue).alias("total_revenue"), F.countDistinct("invoice_id").alias("total_orders"), *corr
    ).withColumn("m", extremes.scalar()).select(
        "total_revenue",
        "total_orders",
        ratio_or_zero(F.col("total_revenue"), F.col("total_orders")).alias("aov"),
        F.col("m.peak.month").alias("peak_month"),
        F.col("m.peak.revenue").alias("peak_revenue"),
        F.col("m.lowest.month").alias("lowest_month"),
        F.col("m.lowest.revenue").alias("lowest_revenue"),
        "corr_revenue_unit_price", "corr_revenue_quantity", "corr_revenue_discount",
    )
