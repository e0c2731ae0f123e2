"""Customer analyses: segments, RFM, cohort retention and lifetime value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.selection import tiers, tiers_of
from tillsight.functions.semantics import exact_sum, mean, ratio, ratio_or_zero, round_half_up, total_or_zero
from tillsight.functions.skew import join_back
from tillsight.operators import features as f
from tillsight.session import stage

DAYS_PER_YEAR = 365.25
MIN_OBSERVED_DAYS = 30


def staged_summary(lines: DataFrame) -> DataFrame:
    """Customer summary written once, because its users read it several times."""
    return stage(f.customer_summary(lines), "customer_summary")


def customer_overview(lines: DataFrame) -> DataFrame:
    per_customer = lines.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        exact_sum(F.col("revenue")).alias("revenue")
    )
    return per_customer.agg(
        F.count("*").alias("customers"),
        round_half_up(ratio(F.sum("revenue"), F.count("*")), 2).alias("avg_revenue_per_customer"),
    )


def customer_segments(lines: DataFrame) -> DataFrame:
    return f.customer_segments(staged_summary(lines))


def segment_summary(lines: DataFrame) -> DataFrame:
    summary = customer_segments(lines).filter(F.col("customer_segment").isNotNull()).groupBy("customer_segment").agg(
        F.count("*").alias("customers"), total_or_zero(F.col("customer_revenue")).alias("revenue")
    )
    return f.segment_order(summary, "customer_segment", s.CUSTOMER_SEGMENTS)


def new_vs_returning(lines: DataFrame) -> DataFrame:
    """Revenue on first-purchase days against all other revenue.

    Lines collapse to one row per customer and day, then per customer the earliest
    day is a mergeable minimum; no line is joined back to its customer.
    """
    daily = lines.groupBy("customer_id", "transaction_date").agg(exact_sum(F.col("revenue")).alias("revenue"))
    first_day = F.min(F.struct("transaction_date", "revenue"))
    per_customer = daily.groupBy("customer_id").agg(
        first_day.alias("first_day"), F.sum("revenue").alias("revenue"), F.count("*").alias("days")
    )
    known = F.col("customer_id").isNotNull()
    new = F.when(known, F.col("first_day.revenue"))
    later = F.when(known & (F.col("days") > 1), F.col("revenue") - F.col("first_day.revenue")).when(~known, F.col("revenue"))
    kinds = F.array(
        F.struct(F.lit("New").alias("customer_type"), F.sum(new).alias("revenue")),
        F.struct(F.lit("Returning").alias("customer_type"), F.sum(later).alias("revenue")),
    )
    split = per_customer.agg(kinds.alias("kinds")).select(F.inline("kinds"))
    return split.filter(F.col("revenue").isNotNull()).withColumn("revenue", F.col("revenue").cast("double"))


def _revenue_per_customer(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue summed per customer before the master join, so only customers are joined."""
    per_customer = lines.groupBy("customer_id").agg(exact_sum(F.col("revenue")).alias("revenue"))
    return f.with_customers(per_customer, customers)


def revenue_by_age_group(lines: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    aged = f.demographics(_revenue_per_customer(lines, customers), as_of)
    summary = aged.filter(F.col("age_group").isNotNull()).groupBy("age_group").agg(F.sum("revenue").cast("double").alias("revenue"))
    return f.segment_order(summary, "age_group", tuple(label for _, _, label in s.AGE_BANDS))


def top_customer_cities(lines: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    placed = _revenue_per_customer(lines, customers).withColumn("city", F.coalesce("city", F.lit(s.UNKNOWN)))
    return placed.groupBy("city").agg(F.sum("revenue").cast("double").alias("revenue")).orderBy(F.desc("revenue"), "city").limit(n)


# ---- RFM --------------------------------------------------------------------

def _rfm_segment() -> Column:
    r, freq, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        F.when((r >= 4) & (freq >= 4) & (m >= 4), "Champions")
        .when((r >= 4) & (freq >= 3), "Loyal Customers")
        .when((r >= 4) & (freq <= 2), "New / Promising")
        .when((r <= 2) & (freq >= 4), "At Risk")
        .when((r <= 2) & (freq <= 2), "Lost")
        .otherwise("Need Attention")
    )


def rfm(lines: DataFrame) -> DataFrame:
    """Recency, frequency and monetary scores (1 to 5) and segment of known customers."""
    known = lines.filter(f.is_known_customer()).groupBy("customer_id").agg(
        F.max("transaction_date").alias("last_purchase"),
        F.countDistinct("invoice_id").alias("frequency"),
        total_or_zero(F.col("revenue")).alias("monetary"),
    )
    known = stage(known, "rfm")
    day_after = known.agg(F.date_add(F.max("last_purchase"), 1).alias("d"))
    base = known.withColumn("recency", F.datediff(day_after.scalar(), F.col("last_purchase"))).drop("last_purchase")
    scored = tiers_of(base, {"_r": "recency", "f_score": "frequency", "m_score": "monetary"}, "customer_id", 5)
    scored = scored.withColumn("r_score", F.lit(6) - F.col("_r")).drop("_r")
    scores = [F.col(c) for c in ("r_score", "f_score", "m_score")]
    return scored.withColumns({
        "rfm_score": scores[0] + scores[1] + scores[2],
        "rfm_code": F.concat(*[c.cast("string") for c in scores]),
        "rfm_segment": _rfm_segment(),
    })


def rfm_segment_summary(lines: DataFrame) -> DataFrame:
    return rfm(lines).groupBy("rfm_segment").agg(
        F.count("*").alias("customers"),
        mean(F.col("recency")).alias("avg_recency"),
        mean(F.col("frequency")).alias("avg_frequency"),
        total_or_zero(F.col("monetary")).alias("revenue"),
        mean(F.col("rfm_score")).alias("avg_rfm_score"),
    ).orderBy(F.desc("revenue"), "rfm_segment")


def top_rfm_customers(lines: DataFrame, n: int = 10) -> DataFrame:
    return rfm(lines).orderBy(F.desc("rfm_score"), "customer_id").limit(n)


# ---- cohorts ----------------------------------------------------------------

def _purchases(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("revenue") > 0) & f.is_known_customer())


def _months_between(earlier: Column, later: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def cohort_index(lines: DataFrame) -> DataFrame:
    """Each purchase line with its customer's first month and the 1-based month distance."""
    purchases = _purchases(lines)
    first = purchases.groupBy("customer_id").agg(F.min("transaction_date").alias("first_purchase"))
    dated = join_back(purchases, first, ["customer_id"])
    return dated.withColumns({
        "order_month": F.date_format("transaction_date", "yyyy-MM"),
        "cohort_month": F.date_format("first_purchase", "yyyy-MM"),
        "cohort_index": _months_between(F.col("first_purchase"), F.col("transaction_date")) + 1,
    })


WORD_MONTHS = 60  # months of one bitmap word; a long holds them without its sign


def month_bitmaps(lines: DataFrame) -> DataFrame:
    """Months with a purchase per customer: ``bits`` of each ``word`` of five years, merged by ``bit_or`` before any exchange."""
    day = F.col("transaction_date")
    number = F.year(day) * 12 + F.month(day) - 1
    bit = F.expr(f"shiftleft(1L, number % {WORD_MONTHS})")
    marked = _purchases(lines).select("customer_id", number.alias("number")).select(
        "customer_id", F.floor(F.col("number") / WORD_MONTHS).cast("int").alias("word"), bit.alias("bit")
    )
    return marked.groupBy("customer_id", "word").agg(F.bit_or("bit").alias("bits"))


def _month_name(number: Column) -> Column:
    year, month = F.floor(number / 12).cast("string"), (number % 12 + 1).cast("string")
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"))


def cohort_retention(lines: DataFrame) -> DataFrame:
    """Active customers and their share of the cohort, per cohort month and index.

    All follows from the bitmaps of ``month_bitmaps``: a customer's cohort is the lowest set bit, and every set bit
    is an active month. Customers are grouped, never ordered.
    """
    bits = F.col("bits")
    lowest = F.bit_count(bits.bitwiseAND(-bits) - 1) + F.col("word") * WORD_MONTHS
    customers = month_bitmaps(lines).groupBy("customer_id").agg(F.min(lowest).alias("first"), F.collect_list(F.struct("word", "bits")).alias("words"))
    months = F.filter(F.sequence(F.lit(0), F.lit(WORD_MONTHS - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    active = customers.select("first", F.inline("words")).select("first", "word", F.explode(months).alias("month"))
    index = (F.col("word") * WORD_MONTHS + F.col("month") - F.col("first") + 1).cast("int")
    counted = active.groupBy(_month_name(F.col("first")).alias("cohort_month"), index.alias("cohort_index")).agg(F.count("*").alias("customers"))
    size = F.max(F.when(F.col("cohort_index") == 1, F.col("customers"))).over(Window.partitionBy("cohort_month"))
    return counted.withColumn("cohort_size", size).withColumn(
        "retention", round_half_up(ratio(F.col("customers"), F.col("cohort_size")), 4)
    )


def cohort_matrix(lines: DataFrame, cohorts: int | None = None, months: int | None = None) -> DataFrame:
    """Retention of all cohorts, or of the first ones, as one column per month index, 0 where inactive.

    The columns reach to ``months``; without it to the highest index in the data, the only value read to plan them.
    """
    retention = stage(cohort_retention(lines), "cohort_retention")
    last = months if months is not None else retention.agg(F.max("cohort_index")).first()[0] or 0
    names = [f"m{i:02d}" for i in range(1, last + 1)]
    wide = (
        retention.withColumn("column", F.format_string("m%02d", F.col("cohort_index")))
        .groupBy("cohort_month")
        .pivot("column", names)
        .agg(F.max("retention"))
        if names else retention.select("cohort_month")
    )
    ordered = wide.na.fill(0.0, names).orderBy("cohort_month")
    return ordered if cohorts is None else ordered.limit(cohorts)


# ---- lifetime value ---------------------------------------------------------

def customer_value(lines: DataFrame) -> DataFrame:
    """Lifespan, observed days (at least 30) and annualised revenue of known customers."""
    return _customer_value(stage(f.customer_summary(lines.filter(f.is_known_customer())), "customer_value"))


def _customer_value(known: DataFrame) -> DataFrame:
    day_after = known.agg(F.date_add(F.max("last_purchase"), 1).alias("d")).scalar()
    observed = F.greatest(F.datediff(day_after, F.col("first_purchase")), F.lit(MIN_OBSERVED_DAYS))
    return (
        known.withColumn("customer_lifespan_days", F.datediff("last_purchase", "first_purchase"))
        .withColumn("observed_customer_days", observed)
        .withColumn(
            "annualized_clv",
            F.col("customer_revenue") / (F.col("observed_customer_days").cast("double") / F.lit(DAYS_PER_YEAR)),
        )
        .withColumn("historical_clv", F.col("customer_revenue"))
    )


def clv_tiers(lines: DataFrame) -> DataFrame:
    tiered = tiers(customer_value(lines), "historical_clv", "customer_id", 4, "clv_tier_ord")
    label = F.element_at(F.array(*[F.lit(t) for t in s.CLV_TIERS]), F.col("clv_tier_ord"))
    return tiered.withColumn("clv_tier", label)


def clv_tier_summary(lines: DataFrame) -> DataFrame:
    return clv_tiers(lines).groupBy("clv_tier", "clv_tier_ord").agg(
        F.count("*").alias("customers"),
        total_or_zero(F.col("historical_clv")).alias("revenue"),
        mean(F.col("historical_clv")).alias("avg_clv"),
        mean(F.col("customer_orders")).alias("avg_orders"),
        mean(F.col("customer_AOV")).alias("avg_aov"),
        mean(F.col("customer_lifespan_days")).alias("avg_lifespan_days"),
        mean(F.col("observed_customer_days")).alias("avg_observed_days"),
        mean(F.col("annualized_clv")).alias("avg_annualized_clv"),
    )


def clv_overview(lines: DataFrame) -> DataFrame:
    known = f.customer_summary(lines.filter(f.is_known_customer()))
    totals = known.agg(
        exact_sum(F.col("customer_revenue")).alias("revenue"),
        F.sum("customer_orders").alias("orders"),
        F.count("*").alias("customers"),
        mean(F.datediff("last_purchase", "first_purchase")).alias("avg_lifespan_days"),
    )
    return totals.select(
        ratio_or_zero(F.col("revenue"), F.col("orders")).alias("average_order_value"),
        ratio_or_zero(F.col("orders"), F.col("customers")).alias("purchase_frequency"),
        ratio_or_zero(F.col("revenue"), F.col("customers")).alias("historical_clv"),
        "avg_lifespan_days",
    )


def top_clv_customers(lines: DataFrame, n: int = 10) -> DataFrame:
    return clv_tiers(lines).orderBy(F.desc("historical_clv"), "customer_id").limit(n)
