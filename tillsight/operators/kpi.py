"""Dashboard figures that are named in prose only; the definitions here are our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.selection import quantiles
from tillsight.functions.semantics import exact_sum, ratio, ratio_or_zero, tally_or_zero, total_or_zero
from tillsight.operators import features as f
from tillsight.operators.discount import campaign_summary, in_campaign
from tillsight.operators.product import abc_classes, product_summary
from tillsight.operators.store import STORE_KEYS, store_summary
from tillsight.session import stage


def new_customers_by_month(lines: DataFrame) -> DataFrame:
    first = lines.filter(f.is_known_customer()).groupBy("customer_id").agg(F.min("month").alias("month"))
    return first.groupBy("month").agg(F.count("*").alias("new_customers")).orderBy("month")


def repeat_rate(lines: DataFrame) -> DataFrame:
    """Share of known customers with at least two orders."""
    per_customer = lines.filter(f.is_known_customer()).groupBy("customer_id").agg(F.countDistinct("invoice_id").alias("orders"))
    counts = per_customer.agg(F.count("*").alias("customers"), tally_or_zero(F.col("orders") >= 2).alias("repeat_customers"))
    return counts.withColumn("repeat_rate", ratio_or_zero(F.col("repeat_customers"), F.col("customers")))


def customers_by_place(lines: DataFrame, customers: DataFrame) -> DataFrame:
    per_customer = lines.filter(f.is_known_customer()).groupBy("customer_id").agg(exact_sum(F.col("revenue")).alias("revenue"))
    placed = f.with_customers(per_customer, customers).withColumns({
        c: F.coalesce(c, F.lit(s.UNKNOWN)) for c in ("country", "city")
    })
    return placed.groupBy("country", "city").agg(
        F.count("*").alias("customers"), F.sum("revenue").cast("double").alias("revenue")
    )


def profitable_products(lines: DataFrame) -> DataFrame:
    profit = F.col("gross_profit")
    return product_summary(lines).agg(
        tally_or_zero(profit < 0).alias("loss_making_products"),
        tally_or_zero(profit > 0).alias("profitable_products"),
        tally_or_zero(profit == 0).alias("break_even_products"),
    )


def revenue_contribution(lines: DataFrame) -> DataFrame:
    return abc_classes(lines).select("product_id", "product_name", "abc_class", "revenue", "revenue_share")


def demand_by_hour(lines: DataFrame) -> DataFrame:
    hour = F.hour(F.try_to_timestamp("transaction_datetime"))
    return lines.groupBy(hour.alias("hour")).agg(
        F.countDistinct("invoice_id").alias("orders"), total_or_zero(F.col("revenue")).alias("revenue")
    ).orderBy("hour")


def store_matrix(lines: DataFrame) -> DataFrame:
    """Stores placed above or below the median revenue and margin; the best by revenue flagged."""
    stores = stage(store_summary(lines).select(*STORE_KEYS, "revenue", "profit_margin"), "store_matrix")
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("revenue", "profit_margin")]
    medians = quantiles(stores.select(F.inline(F.array(*cells))), (0.5,)).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.col("quantiles")[0].alias("v")))).alias("m")
    )
    placed = stores.withColumn("_m", medians.scalar()).withColumn("_best", stores.agg(F.max("revenue").alias("b")).scalar())

    def side(measure):
        return F.when(F.col(measure) > F.col("_m")[measure], "High").otherwise("Low")

    return placed.select(
        *STORE_KEYS, "revenue", "profit_margin",
        side("revenue").alias("revenue_side"), side("profit_margin").alias("margin_side"),
        (F.col("revenue") == F.col("_best")).alias("is_best"),
    )


def discount_share(lines: DataFrame) -> DataFrame:
    """Discounted share of revenue, and discount granted per unit of gross sales."""
    totals = lines.agg(
        total_or_zero(F.when(F.col("discount") > 0, F.col("revenue"))).alias("discounted_revenue"),
        total_or_zero(F.col("revenue")).alias("revenue"),
        total_or_zero(F.col("discount_amount")).alias("discount_amount"),
        total_or_zero(F.col("gross_sales")).alias("gross_sales"),
    )
    return totals.withColumns({
        "discount_share": ratio(F.col("discounted_revenue"), F.col("revenue")),
        "effective_discount_rate": ratio(F.col("discount_amount"), F.col("gross_sales")),
    })


def campaign_matrix(lines: DataFrame) -> DataFrame:
    """Campaign revenue, profit and margin with the best of each flagged."""
    rows = campaign_summary(lines).select("campaign_description", "orders", "revenue", "gross_profit", "profit_margin")
    best = rows.agg(F.struct(F.max("revenue").alias("revenue"), F.max("gross_profit").alias("gross_profit")).alias("b"))
    return rows.withColumn("_b", best.scalar()).withColumns({
        "is_best_revenue": F.col("revenue") == F.col("_b.revenue"),
        "is_best_profit": F.col("gross_profit") == F.col("_b.gross_profit"),
    }).drop("_b")


def campaign_roi(lines: DataFrame) -> DataFrame:
    """Gross profit returned per unit of discount granted, less one."""
    per_campaign = in_campaign(lines).groupBy("campaign_description").agg(
        total_or_zero(F.col("gross_profit")).alias("gross_profit"),
        total_or_zero(F.col("discount_amount")).alias("discount_amount"),
    )
    return per_campaign.withColumn("roi", ratio(F.col("gross_profit"), F.col("discount_amount")) - 1)


def campaign_payback(lines: DataFrame) -> DataFrame:
    """First day on which a campaign's cumulative profit covers all discount it granted.

    The running sum is over one row per campaign and calendar day.
    """
    daily = in_campaign(lines).groupBy("campaign_description", "transaction_date").agg(
        exact_sum(F.col("gross_profit")).alias("gross_profit"),
        exact_sum(F.col("discount_amount")).alias("discount_amount"),
    )
    campaign = Window.partitionBy("campaign_description")
    so_far = campaign.orderBy("transaction_date").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumns({
        "cumulative_profit": F.sum("gross_profit").over(so_far),
        "total_discount": F.sum("discount_amount").over(campaign),
    })
    covered = F.col("cumulative_profit") >= F.col("total_discount")
    return run.groupBy("campaign_description").agg(
        F.min("transaction_date").alias("first_day"),
        F.min(F.when(covered, F.col("transaction_date"))).alias("payback_day"),
        F.max("total_discount").cast("double").alias("discount_amount"),
        F.sum("gross_profit").cast("double").alias("gross_profit"),
    ).withColumn("days_to_payback", F.datediff("payback_day", "first_day"))
