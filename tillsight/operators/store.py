"""Store analyses over lines enriched with product and store masters (``features.store_lines``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.bands import band
from tillsight.functions.distinct import counted, pairs, with_distinct
from tillsight.functions.semantics import exact_sum, mean, ratio, ratio_or_zero, tally_or_zero, total_or_zero
from tillsight.operators.features import exclusions, is_unknown_store, segment_order
from tillsight.operators.product import RETURNED, SIGNED_UNITS, SOLD, orders, sums, top, units, with_margin, with_return_rate

STORE_KEYS = ("store_id", "store_name", "country", "city")


def known_stores(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_unknown_store())


def unknown_store_split(lines: DataFrame) -> DataFrame:
    return exclusions(lines, is_unknown_store())


def _with_aov(summary: DataFrame) -> DataFrame:
    return summary.withColumn("aov", ratio(F.col("revenue"), F.col("orders")))


def _distinct(column: str, name: str):
    return F.countDistinct(column).alias(name)


def store_summary(lines: DataFrame) -> DataFrame:
    """Measures of every known store, in total and per employee."""
    measures = [
        *sums("revenue", "gross_profit"), *units(SIGNED_UNITS, SOLD, RETURNED),
        mean(F.col("discount")).alias("avg_discount"), tally_or_zero(F.col("is_return")).alias("return_rows"),
    ]
    counts = {"orders": "invoice_id", "customers": "customer_id", "products": "product_id"}
    summary = with_distinct(known_stores(lines), [*STORE_KEYS, "number_of_employees"], measures, counts)
    staff = F.col("number_of_employees")
    return with_return_rate(with_margin(_with_aov(summary))).withColumns({
        "revenue_per_employee": ratio(F.col("revenue"), staff),
        "profit_per_employee": ratio(F.col("gross_profit"), staff),
        "orders_per_employee": ratio(F.col("orders"), staff),
    })


def store_overview(lines: DataFrame) -> DataFrame:
    """Known-store totals (orders summed over stores) beside what the filter leaves out."""
    unknown = is_unknown_store()
    per_store = lines.groupBy("store_id", unknown.alias("unknown")).agg(
        F.count("*").alias("rows"),
        exact_sum(F.col("revenue")).alias("revenue"),
        exact_sum(F.col("gross_profit")).alias("gross_profit"),
        orders(),
    )
    known = ~F.col("unknown")

    def amount(condition, c):
        return F.coalesce(F.sum(F.when(condition, F.col(c))).cast("double"), F.lit(0.0))

    overview = per_store.agg(
        F.countDistinct(F.when(known, F.col("store_id"))).alias("active_stores"),
        F.coalesce(F.sum(F.when(F.col("unknown"), F.col("rows"))), F.lit(0)).alias("unknown_store_rows"),
        amount(F.col("unknown"), "revenue").alias("unknown_store_revenue"),
        amount(known, "revenue").alias("revenue"),
        amount(known, "gross_profit").alias("gross_profit"),
        F.coalesce(F.sum(F.when(known, F.col("orders"))), F.lit(0)).alias("orders"),
    )
    return overview.withColumns({
        "gross_margin": ratio_or_zero(F.col("gross_profit"), F.col("revenue")),
        "avg_revenue_per_store": ratio_or_zero(F.col("revenue"), F.col("active_stores")),
    })


REVENUE_VIEW = ("revenue", "orders", "gross_profit", "profit_margin", "aov")


def top_stores(lines: DataFrame, n: int = 10) -> DataFrame:
    return top(store_summary(lines), n, F.desc("revenue"), STORE_KEYS, REVENUE_VIEW)


def bottom_stores(lines: DataFrame, n: int = 10) -> DataFrame:
    return top(store_summary(lines), n, F.asc("revenue"), STORE_KEYS, REVENUE_VIEW)


def top_stores_per_employee(lines: DataFrame, n: int = 10) -> DataFrame:
    columns = ("number_of_employees", "revenue", "revenue_per_employee", "profit_per_employee", "orders_per_employee")
    return top(store_summary(lines), n, F.desc_nulls_last("revenue_per_employee"), STORE_KEYS, columns)


def _by_place(lines: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Measures per place. What distinct counts need, stores included, is first reduced to sets per store."""
    known = known_stores(lines)
    summary = known.groupBy(*keys).agg(*sums("revenue", "gross_profit"), *units(SOLD, RETURNED), *more)
    for name, column in {"stores": "store_id", "orders": "invoice_id", "customers": "customer_id"}.items():
        summary = summary.join(counted(pairs(pairs(known, [*keys, "store_id"], column), keys, column), keys, column, name), list(keys))
    return summary


def country_performance(lines: DataFrame) -> DataFrame:
    summary = _by_place(lines, "country", more=(mean(F.col("discount")).alias("avg_discount"),))
    return with_return_rate(with_margin(_with_aov(summary)))


def top_store_cities(lines: DataFrame, n: int = 15) -> DataFrame:
    summary = with_return_rate(with_margin(_by_place(lines, "country", "city")))
    columns = tuple(c for c in summary.columns if c not in ("country", "city"))
    return top(summary, n, F.desc("revenue"), ("country", "city"), columns)


def highest_return_rates(lines: DataFrame, n: int = 10) -> DataFrame:
    columns = ("units_sold", "units_returned", "return_rate", "revenue")
    return top(store_summary(lines), n, F.desc_nulls_last("return_rate"), STORE_KEYS, columns)


def highest_discounts(lines: DataFrame, n: int = 10) -> DataFrame:
    columns = ("avg_discount", "revenue", "gross_profit", "profit_margin")
    return top(store_summary(lines), n, F.desc_nulls_last("avg_discount"), STORE_KEYS, columns)


def top_category_by_store(lines: DataFrame) -> DataFrame:
    """Best category of every store; the winner is a mergeable minimum, not a ranked window."""
    mix = known_stores(lines).groupBy(*STORE_KEYS, "category").agg(
        exact_sum(F.col("revenue")).alias("revenue"),
        total_or_zero(F.col("gross_profit")).alias("gross_profit"),
        *units(SIGNED_UNITS),
    )
    first = F.min(F.struct(
        (-F.col("revenue")).alias("falling"), "store_name", "country", "city", "category", "revenue", "gross_profit", "quantity"
    ))
    best = mix.groupBy("store_id").agg(first.alias("best"))
    return best.select(
        "store_id", "best.store_name", "best.country", "best.city", "best.category",
        F.col("best.revenue").cast("double").alias("revenue"), "best.gross_profit", "best.quantity",
    )


def country_category_mix(lines: DataFrame) -> DataFrame:
    return known_stores(lines).groupBy("country", "category").agg(*sums("revenue", "gross_profit"), *units(SIGNED_UNITS))


def monthly_top_stores(lines: DataFrame, n: int = 5) -> DataFrame:
    """Monthly revenue of the store names behind the ``n`` best-selling stores."""
    monthly = known_stores(lines).groupBy("month", *STORE_KEYS).agg(exact_sum(F.col("revenue")).alias("revenue"))
    best = (
        monthly.groupBy(*STORE_KEYS).agg(F.sum("revenue").alias("r")).orderBy(F.desc("r"), *STORE_KEYS).limit(n)
        .select("store_name").distinct()
    )
    return (
        monthly.join(F.broadcast(best), "store_name", "left_semi")
        .groupBy("month", "store_name")
        .agg(F.sum("revenue").cast("double").alias("revenue"))
        .orderBy("month", "store_name")
    )


def productivity_by_employee_band(lines: DataFrame) -> DataFrame:
    labels = tuple(label for _, _, label in s.EMPLOYEE_BANDS)
    banded = store_summary(lines).withColumn(
        "employee_band", band(F.col("number_of_employees"), s.EMPLOYEE_BANDS, include_lowest=True)
    )
    summary = banded.groupBy("employee_band").agg(
        _distinct("store_id", "stores"), *sums("revenue"),
        mean(F.col("revenue_per_employee")).alias("avg_revenue_per_employee"),
        mean(F.col("profit_per_employee")).alias("avg_profit_per_employee"),
    )
    return segment_order(summary, "employee_band", labels)
