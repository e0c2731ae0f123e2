"""Derived columns: line items, invoices, and their product, store, customer and campaign context.

All row-level steps are narrow. Master tables are joined without forcing a
broadcast: the planner broadcasts them by measured size and otherwise sorts and
merges, splitting hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.bands import band, band_order, quartile_band
from tillsight.functions.distinct import with_distinct
from tillsight.functions.semantics import (
    finite, magnitude, ratio, tally_or_zero, to_day, to_number_or_null, total_or_zero, whole_sum,
)
from tillsight.functions.skew import join_back
from tillsight.session import stage

CORE_FIELDS = ("transaction_date", "invoice_id", "unit_price", "quantity", "discount", "line_total")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


# ---- line items -------------------------------------------------------------

def coerce_types(fact: DataFrame) -> DataFrame:
    """Dates and amounts as typed columns; values that do not parse become NULL."""
    types = dict(fact.dtypes)
    fixed = {}
    if types["transaction_date"] == "string":
        fixed["transaction_date"] = to_day(F.col("transaction_date"))
    for name in ("unit_price", "quantity", "discount", "line_total"):
        if types[name] == "string":
            fixed[name] = to_number_or_null(F.col(name))
        elif types[name] in ("double", "float"):
            fixed[name] = finite(F.col(name))
    return fact.withColumns(fixed)


def drop_unusable(fact: DataFrame) -> DataFrame:
    """Keep rows that have all the fields sales figures need."""
    return fact.na.drop(subset=list(CORE_FIELDS))


def sales_measures(lines: DataFrame) -> DataFrame:
    return lines.withColumn("gross_sales", F.col("unit_price") * F.col("quantity")).withColumn(
        "discount_amount", F.col("gross_sales") * F.col("discount")
    )


def _return_flag() -> Column:
    return F.coalesce(F.lower(F.trim("transaction_type")) == "return", F.lit(False))


def signed_revenue(lines: DataFrame) -> DataFrame:
    """Line total with the sign of its direction: negative for returns."""
    amount = F.abs("line_total")
    return lines.withColumn("revenue", F.when(_return_flag(), -amount).otherwise(amount))


def time_features(lines: DataFrame) -> DataFrame:
    day = F.col("transaction_date")
    return lines.withColumns({
        "year": F.year(day),
        "month": F.date_format(day, "yyyy-MM"),
        "quarter": F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")),
        "day": F.dayofmonth(day),
        "weekday": F.date_format(day, "EEEE"),
        "is_weekend": F.weekday(day) >= 5,
    })


def return_flag(lines: DataFrame) -> DataFrame:
    return lines.withColumn("is_return", _return_flag())


def price_segments(lines: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return quartile_band(lines, "unit_price", s.PRICE_SEGMENTS, "price_segment", edges)


def discount_groups(lines: DataFrame) -> DataFrame:
    return lines.withColumn("discount_group", band(F.col("discount"), s.DISCOUNT_BANDS))


def weekday_order(lines: DataFrame) -> DataFrame:
    """Monday = 0 position beside the weekday name."""
    return lines.withColumn("weekday_ord", F.weekday("transaction_date"))


def line_items(fact: DataFrame) -> DataFrame:
    """Sales lines with every narrow feature (``price_segments`` is added on demand)."""
    lines = drop_unusable(coerce_types(fact))
    for step in (sales_measures, signed_revenue, time_features, return_flag, discount_groups, weekday_order):
        lines = step(lines)
    return lines


# ---- invoices ---------------------------------------------------------------

def invoice_summary(lines: DataFrame) -> DataFrame:
    measures = [
        F.min("transaction_date").alias("order_date"),
        total_or_zero(F.col("revenue")).alias("order_revenue"),
        total_or_zero(F.col("gross_sales")).alias("order_gross_sales"),
        total_or_zero(F.col("discount_amount")).alias("order_discount_amount"),
        F.coalesce(whole_sum(F.col("quantity")), F.lit(0)).alias("order_quantity"),
        F.max("is_return").alias("has_return"),
    ]
    counts = {"line_count": "line_no", "unique_products": "product_id", "unique_customers": "customer_id"}
    return with_distinct(lines, ["invoice_id"], measures, counts)


def item_value(invoices: DataFrame) -> DataFrame:
    """Revenue per unit of each order; NULL when it has no units."""
    return invoices.withColumn("avg_item_per_order", ratio(F.col("order_revenue"), F.col("order_quantity")))


def basket_groups(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn(
        "basket_size_group", band(F.col("order_quantity"), s.BASKET_BANDS, include_lowest=True)
    )


def order_value_groups(invoices: DataFrame) -> DataFrame:
    return quartile_band(invoices, "order_revenue", s.ORDER_VALUE_GROUPS, "order_value_group")


def prepare_sales(fact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line items with price segments, and invoices with basket and value groups."""
    lines = price_segments(line_items(fact))
    invoices = stage(invoice_summary(lines), "invoices")
    return lines, order_value_groups(basket_groups(item_value(invoices)))


# ---- products and stores ----------------------------------------------------

def with_products(lines: DataFrame, products: DataFrame, *more: str) -> DataFrame:
    """Left join product masters; missing attributes read ``Unknown`` and cost 0. Columns in ``more`` come along as they are."""
    unknown = F.lit(s.UNKNOWN)
    masters = products.select(
        F.col("product_id").cast("string").alias("product_id"),
        "category",
        "sub_category",
        F.col("description_en").alias("product_name"),
        F.col("color").alias("product_master_color"),
        F.col("size").alias("available_sizes"),
        F.coalesce(to_number_or_null(F.col("production_cost")), F.lit(0.0)).alias("production_cost"),
        *more,
    )
    return lines.join(masters, "product_id", "left").withColumns({
        "product_name": F.coalesce("product_name", F.lit("Unknown Product")),
        **{c: F.coalesce(c, unknown) for c in ("category", "sub_category", "product_master_color", "available_sizes")},
        "production_cost": F.coalesce("production_cost", F.lit(0.0)),
    })


def profit_measures(lines: DataFrame) -> DataFrame:
    is_return, quantity = F.col("is_return"), F.col("quantity")
    zero = F.lit(0)
    return (
        lines.withColumns({
            "signed_quantity": F.when(is_return, -magnitude(quantity)).otherwise(magnitude(quantity)),
            "units_sold": F.when(is_return, zero).otherwise(quantity),
            "units_returned": F.when(is_return, quantity).otherwise(zero),
        })
        .withColumn("cost_impact", F.col("production_cost") * F.col("signed_quantity"))
        .withColumn("gross_profit", F.col("revenue") - F.col("cost_impact"))
        .withColumn("profit_margin", ratio(F.col("gross_profit"), F.col("revenue")))
    )


def product_lines(lines: DataFrame, products: DataFrame, *more: str) -> DataFrame:
    return profit_measures(with_products(lines, products, *more))


def is_unknown_product() -> Column:
    return (F.upper("product_id") == s.UNKNOWN_PRODUCT) | (F.col("category") == s.UNKNOWN)


def with_stores(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Left join store masters; missing attributes read ``Unknown`` and 0 employees."""
    masters = stores.select(
        F.col("store_id").cast("string").alias("store_id"), "store_name", "country", "city", "zip_code",
        to_number_or_null(F.col("number_of_employees")).alias("number_of_employees"),
    )
    return lines.join(masters, "store_id", "left").withColumns({
        "store_name": F.coalesce("store_name", F.lit("Unknown Store")),
        **{c: F.coalesce(c, F.lit(s.UNKNOWN)) for c in ("country", "city", "zip_code")},
        "number_of_employees": F.coalesce("number_of_employees", F.lit(0.0)),
    })


def is_unknown_store() -> Column:
    return (F.col("store_name") == "Unknown Store") | (F.col("country") == s.UNKNOWN)


def store_lines(lines: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Lines beside their product and their store.

    Products are joined last: what reads none of their columns, such as a distinct count, then drops their join.
    """
    return product_lines(with_stores(lines, stores), products)


def exclusions(lines: DataFrame, unknown: Column) -> DataFrame:
    """How many rows, and how much revenue, an unknown-member filter removes."""
    return lines.agg(
        tally_or_zero(unknown).alias("excluded_rows"),
        total_or_zero(F.when(unknown, F.col("revenue"))).alias("excluded_revenue"),
        tally_or_zero(~unknown).alias("kept_rows"),
        total_or_zero(F.when(~unknown, F.col("revenue"))).alias("kept_revenue"),
    )


# ---- campaigns --------------------------------------------------------------

def campaigns(discounts: DataFrame) -> DataFrame:
    """Typed campaign list without incomplete rows."""
    return discounts.select(
        "campaign_seq",
        F.try_to_timestamp(F.col("start").cast("string")).alias("start"),
        F.try_to_timestamp(F.col("end").cast("string")).alias("end"),
        to_number_or_null(F.col("discount")).alias("discount"),
        "category", "sub_category", "description",
    ).na.drop(subset=["start", "end", "discount", "category", "sub_category"])


CAMPAIGN_KEY = ("category", "sub_category")
LEVELS = 31


def _cover(begin: Column, end: Column) -> Column:
    """The (level, node) pairs whose binary blocks of positions make up [begin, end): two for each level at most."""
    empty = F.array().cast("array<struct<level:int,node:int>>")

    def climb(state: Column, level: Column) -> Column:
        i, j = state["i"], state["j"]
        open_ = i < j
        left, right = open_ & (i % 2 == 1), open_ & (j % 2 == 1)

        def block(chosen: Column, node: Column) -> Column:
            return F.when(chosen, F.array(F.struct(level.alias("level"), node.alias("node")))).otherwise(empty)

        nodes = F.concat(state["nodes"], block(left, i), block(right, j - 1))
        return F.struct(F.shiftright(i + left.cast("int"), 1).alias("i"), F.shiftright(j - right.cast("int"), 1).alias("j"), nodes.alias("nodes"))

    start = F.struct(begin.cast("int").alias("i"), end.cast("int").alias("j"), empty.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, climb)["nodes"]


def campaign_segments(active: DataFrame) -> DataFrame:
    """Disjoint stretches of days per (category, sub_category) and the campaign in force: the last listed one wins.

    The first day and the day after the last of every campaign cut the days of a key into at most twice as many stretches as it
    has campaigns. A campaign covers a range of stretches, that is at most two binary blocks of each size; the winner of
    a block is a mergeable ``max``, and that of a stretch the largest among the blocks around it. So overlapping campaigns are
    never paired with each other, and an open-ended one costs no more than others. Campaigns with one number rank by start,
    end, description and discount. ``lo`` and ``width`` divide the days of a key into as many equal parts as it has stretches.
    """
    start_day = F.to_date("start")
    first = F.when(F.col("start") == start_day.cast("timestamp"), start_day).otherwise(F.date_add(start_day, 1))
    place = F.struct("campaign_seq", "start", "end", "description", "discount")
    spans = active.select(
        *CAMPAIGN_KEY, F.unix_date(first).alias("first"), (F.unix_date(F.to_date("end")) + 1).alias("stop"), place.alias("place")
    ).filter(F.col("first") < F.col("stop"))
    days = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("first", "stop")))))
    listed = spans.groupBy(*CAMPAIGN_KEY).agg(days.alias("days"), F.collect_list(F.struct("first", "stop", "place")).alias("spans"))

    def place_of(day: str) -> Column:
        return F.array_position("days", F.col(day)) - 1

    blocks = listed.select(*CAMPAIGN_KEY, "days", F.inline("spans")).select(*CAMPAIGN_KEY, "place", F.inline(_cover(place_of("first"), place_of("stop"))))
    best = blocks.groupBy(*CAMPAIGN_KEY, "level", "node").agg(F.max("place").alias("place"))
    count = F.size("days")
    lo = F.get("days", F.lit(0))
    width = F.greatest(F.lit(1), F.ceil((F.get("days", count - 1) - lo) / (count - 1)).cast("int"))
    cut = listed.select(
        *CAMPAIGN_KEY, lo.alias("lo"), width.alias("width"), F.length(F.bin(count)).alias("levels"),
        F.posexplode(F.arrays_zip(F.col("days").alias("first"), F.slice("days", F.lit(2), count).alias("stop"))).alias("place_no", "stretch"),
    ).filter(F.col("stretch.stop").isNotNull())
    around = cut.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels")))).withColumn("node", F.expr("shiftright(place_no, level)"))
    won = around.join(best, [*CAMPAIGN_KEY, "level", "node"])
    return won.groupBy(*CAMPAIGN_KEY, "lo", "width", "stretch.first", "stretch.stop").agg(F.max("place").alias("place")).select(
        *CAMPAIGN_KEY, "lo", "width", "first", "stop", "place.description", "place.discount"
    )


def campaign_parts(segments: DataFrame) -> DataFrame:
    """``campaign_segments`` gathered by part of their key's days: no more rows than stretches, and in a part no more stretches than days.

    With n stretches over D days a part has D / n days, so at most the square root of D are searched for a line, few as a rule.
    """
    parts = F.sequence(F.floor((F.col("first") - F.col("lo")) / F.col("width")), F.floor((F.col("stop") - 1 - F.col("lo")) / F.col("width")))
    stretch = F.struct("first", "stop", "description", "discount")
    return segments.withColumn("part", F.explode(parts)).groupBy(*CAMPAIGN_KEY, "lo", "width", "part").agg(F.collect_list(stretch).alias("stretches"))


def _listed_parts(discounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``campaign_parts`` and, one row per key, the ``days`` they divide; bit p % 64 of ``mask`` is set if part p is among them."""
    parts = stage(campaign_parts(campaign_segments(campaigns(discounts))), "campaign_parts")
    mask = F.bit_or(F.expr("shiftleft(1L, CAST(part % 64 AS INT))")).alias("mask")
    days = parts.groupBy(*CAMPAIGN_KEY, "lo", "width").agg(mask)
    return parts.drop("lo", "width"), days.select(*CAMPAIGN_KEY, F.struct("lo", "width", "mask").alias("days"))


def _with_stretches(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Campaign in force on the day of each line, whose key's ``days`` are given; a line of no listed part has no part and meets no stretch."""
    day = F.unix_date("transaction_date")
    lines = lines.withColumn("part", F.floor((day - F.col("days.lo")) / F.col("days.width")))
    in_mask = F.expr("shiftright(days.mask, CAST(pmod(part, 64) AS INT)) & 1") == 1
    lines = lines.withColumn("part", F.when(in_mask, F.col("part"))).drop("days")
    joined = join_back(lines, parts, [*CAMPAIGN_KEY, "part"], spread=("transaction_date", *CAMPAIGN_KEY))
    campaign = F.get(F.filter("stretches", lambda x: (x["first"] <= F.unix_date("transaction_date")) & (x["stop"] > F.unix_date("transaction_date"))), F.lit(0))
    joined = joined.withColumn("campaign", campaign).drop("part")
    # that there are stretches at all lets the planner keep lines without a part out of the exchange where only campaigns are asked for
    listed = F.col("stretches").isNotNull() & F.col("campaign").isNotNull()
    return joined.withColumns({
        "campaign_description": F.when(listed, F.col("campaign.description")).otherwise(s.NO_CAMPAIGN),
        "campaign_discount": F.when(listed, F.col("campaign.discount")).otherwise(0.0),
        "is_campaign_period": listed,
    }).drop("campaign", "stretches")


def with_campaigns(lines: DataFrame, discounts: DataFrame) -> DataFrame:
    parts, days = _listed_parts(discounts)
    return _with_stretches(join_back(lines, days, CAMPAIGN_KEY), parts)


def discount_status(lines: DataFrame) -> DataFrame:
    in_campaign = F.col("is_campaign_period")
    lines = lines.withColumns({
        "has_discount": F.col("discount") > 0,
        "discount_gap": F.col("discount") - F.col("campaign_discount"),
    })
    has = F.col("has_discount")
    status = (
        F.when(in_campaign & has, s.STATUS_CAMPAIGN)
        .when(in_campaign, s.STATUS_UNUSED)
        .when(has, s.STATUS_OTHER)
        .otherwise(s.STATUS_NONE)
    )
    return lines.withColumn("discount_status", status)


def discount_lines(lines: DataFrame, products: DataFrame, discounts: DataFrame) -> DataFrame:
    """Lines beside their product and campaign. The days of a campaign's key join the masters, so that lines need no exchange for them."""
    parts, days = _listed_parts(discounts)
    unknown = F.lit(s.UNKNOWN)
    named = products.withColumns({c: F.coalesce(c, unknown) for c in CAMPAIGN_KEY})
    of_unknown = days.filter((F.col("category") == unknown) & (F.col("sub_category") == unknown)).agg(F.max("days")).scalar()
    goods = product_lines(lines, join_back(named, days, CAMPAIGN_KEY), "days")
    # a line without masters reads Unknown, which may be a listed key too
    is_unknown = (F.col("category") == unknown) & (F.col("sub_category") == unknown)
    goods = goods.withColumn("days", F.when(is_unknown, of_unknown).otherwise(F.col("days")))
    return discount_status(_with_stretches(goods, parts))


# ---- customers --------------------------------------------------------------

def with_customers(lines: DataFrame, customers: DataFrame) -> DataFrame:
    return lines.join(customers, "customer_id", "left")


def demographics(lines: DataFrame, as_of: str) -> DataFrame:
    """Fill gender and city, and derive age on ``as_of`` and its generation band."""
    if "age" in lines.columns:
        age = to_number_or_null(F.col("age"))
    elif "date_of_birth" in lines.columns:
        born = F.col("date_of_birth")
        born = to_day(born) if dict(lines.dtypes)["date_of_birth"] == "string" else born.try_cast("date")
        age = F.datediff(F.lit(as_of).cast("date"), born) / F.lit(365.25)
    else:
        age = F.lit(None).cast("double")
    return lines.withColumns({
        "gender": F.coalesce("gender", F.lit(s.UNKNOWN)),
        "city": F.coalesce("city", F.lit(s.UNKNOWN)),
        "age": age,
    }).withColumn("age_group", band(F.col("age"), s.AGE_BANDS))


def is_known_customer() -> Column:
    return F.upper("customer_id") != s.UNKNOWN_CUSTOMER


def customer_summary(lines: DataFrame) -> DataFrame:
    return (
        lines.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            total_or_zero(F.col("revenue")).alias("customer_revenue"),
            F.countDistinct("invoice_id").alias("customer_orders"),
            F.min("transaction_date").alias("first_purchase"),
            F.max("transaction_date").alias("last_purchase"),
        )
        .withColumn("customer_AOV", ratio(F.col("customer_revenue"), F.col("customer_orders")))
    )


def customer_segments(summary: DataFrame) -> DataFrame:
    return quartile_band(summary, "customer_revenue", s.CUSTOMER_SEGMENTS, "customer_segment")


def customer_type(lines: DataFrame) -> DataFrame:
    """``New`` on the day of the customer's first purchase, else ``Returning``."""
    first = lines.groupBy("customer_id").agg(F.min("transaction_date").alias("first_purchase"))
    dated = join_back(lines, first, ["customer_id"])
    is_new = F.col("transaction_date") == F.col("first_purchase")
    return dated.withColumn("customer_type", F.when(is_new, "New").otherwise("Returning"))


def segment_order(df: DataFrame, label: str, labels: tuple[str, ...]) -> DataFrame:
    """Append ``<label>_ord``, the position of an ordered label."""
    return df.withColumn(f"{label}_ord", band_order(F.col(label), labels))
