"""Nothing is capped, clamped or aborted by large values."""

import math
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_clean import dims, raw_table  # noqa: F401
from tests.test_reports import fact, products
from tests.test_semantics import values
from tillsight.functions import semantics as m
from tillsight.operators import clean, customer, features, product, profile, sales, store
from tillsight.plans import pipeline


def test_integers_keep_64_bits_and_then_the_nearest_value(spark):
    texts = ["3000000000", "-3000000000", "9223372036854775807", "9223372036854775808x", "-99999999999999999999", "+5", "2.7"]
    assert values(spark, texts, m.to_int(F.col("x"))) == [3 * 10**9, -3 * 10**9, 2**63 - 1, 2**63 - 1, -(2**63), 5, 2]


def test_sums_beyond_the_range_of_millionths(spark):
    df = spark.createDataFrame([(2e13,), (1.0,), (-0.25,), (None,)], "x double")
    assert df.agg(m.total(F.col("x"))).first()[0] == 20000000000000.75
    assert df.agg(m.mean(F.col("x"))).first()[0] == pytest.approx(20000000000000.75 / 3)


def test_rounding_of_amounts_without_cents(spark):
    amounts = [1e15, 1e17, -1e40, 123456789012345.678]
    assert values(spark, amounts, m.money(F.col("x")), "double") == [1e15, 1e17, -1e40, 123456789012345.67]


def test_second_level_sums_of_large_customers(spark):
    lines = features.line_items(fact(spark, {"line_total": 1.2e13, "unit_price": 1.2e13, "quantity": 1}, {"customer_id": "c2", "invoice_id": "INV-2"}))
    assert sum(r.revenue for r in customer.segment_summary(lines).collect()) == 12_000_000_000_020.0
    assert sum(r.revenue for r in customer.rfm_segment_summary(lines).collect()) == 12_000_000_000_020.0
    assert sum(r.revenue for r in customer.clv_tier_summary(lines).collect()) == 12_000_000_000_020.0
    goods = features.product_lines(lines, products(spark))
    assert sum(r.revenue for r in product.abc_summary(goods).collect()) == 12_000_000_000_020.0


def test_one_huge_amount_does_not_stop_the_cleaning(spark, dims):  # noqa: F811
    raw = raw_table(spark, {"line_total": "1e17"}, {"quantity": "3000000000", "line_total": "", "invoice_id": "INV-2"})
    kept = {r.source_rowid: r for r in clean.clean_rows(raw).collect()}
    assert kept[1].line_total == 1e17 and kept[2].quantity == 3 * 10**9 and kept[2].line_total == 3e10
    final = {r.source_rowid: r for r in clean.final_transactions(clean.impute(raw, dims).imputed).collect()}
    assert final[1].line_total == 1e17 and final[2].quantity == 3 * 10**9
    assert profile.line_total_accuracy(raw).first().possible_inaccurate_line_total_rows == 1
    assert profile.invoice_total_accuracy(raw).first().possible_inaccurate_invoice_total_count == 1


def test_cohort_matrix_has_all_cohorts_and_months(spark):
    days = [date(2010 + i, 3, 1) for i in range(13)]
    lines = features.line_items(fact(
        spark, *[{"transaction_date": d} for d in days], *[{"customer_id": f"n{i}", "transaction_date": date(2012, 1 + i % 12, 5)} for i in range(12)],
        *[{"customer_id": f"o{i}", "transaction_date": date(2015, 1 + i % 12, 5)} for i in range(12)],
    ))
    matrix = {r.cohort_month: r.asDict() for r in customer.cohort_matrix(lines).collect()}
    assert len(matrix) == 25 and len(matrix["2010-03"]) == 1 + 145
    assert [matrix["2010-03"][f"m{i:02d}"] for i in (1, 2, 85, 97, 145)] == [1.0, 0.0, 1.0, 1.0, 1.0]
    assert customer.cohort_matrix(lines, cohorts=3).count() == 3
    assert customer.cohort_matrix(lines.limit(0)).count() == 0


def test_an_open_ended_campaign_costs_no_more_than_another(spark):
    discounts = spark.createDataFrame([
        (1, "2023-01-01 00:00:00", "9999-12-31 00:00:00", "0.1", "Tops", "Shirts", "open"),
        (2, "2023-01-04 00:00:00", "2023-01-05 00:00:00", "0.2", "Tops", "Shirts", "a"),
        (2, "2023-01-04 00:00:00", "2023-01-06 00:00:00", "0.3", "Tops", "Shirts", "b"),
    ], "campaign_seq int, start string, end string, discount string, category string, sub_category string, description string")
    segments = features.campaign_segments(features.campaigns(discounts)).collect()
    days = {d: r.description for d in range(3, 8) for r in segments if r["first"] <= (date(2023, 1, d) - date(1970, 1, 1)).days < r["stop"]}
    assert days == {3: "open", 4: "b", 5: "b", 6: "b", 7: "open"} and len(segments) <= 6
    lines = features.line_items(fact(spark, {"transaction_date": date(2024, 5, 1)}))
    assert features.discount_lines(lines, products(spark), discounts).first().campaign_description == "open"


def test_repeated_master_ids_do_not_multiply_lines(spark, dims):  # noqa: F811
    from dataclasses import replace

    doubled = replace(dims, products=dims.products.unionByName(dims.products), employees=dims.employees.unionByName(dims.employees))
    raw = raw_table(spark, {"product_id": "unknown", "store_id": ""}, {"invoice_id": "INV-2"})
    final = clean.final_transactions(clean.impute(raw, doubled).imputed).collect()
    assert sorted(r.source_rowid for r in final) == [1, 2] and {r.product_id for r in final} == {"12"}


DIRTY = ("1e33", "1e400", "-1e308", "9" * 400)


@pytest.mark.parametrize("amount", DIRTY)
def test_no_amount_stops_a_profile_a_cleaning_or_a_report(spark, dims, amount):  # noqa: F811
    raw = raw_table(spark, {"line_total": amount, "invoice_total": amount}, {"invoice_id": "INV-2", "unit_price": amount}, {"invoice_id": "INV-3", "quantity": "2"})
    representable = amount in ("1e33", "-1e308")
    for report in pipeline.PROFILE_REPORTS.values():
        report(raw).collect()
    gaps = {r.column_name: r.dirty_or_missing_rows if "dirty_or_missing_rows" in r.asDict() else None for r in profile.completeness(raw).collect()}
    assert "line_total" in gaps
    result = clean.cleaned(raw, dims)
    revenue = [r.revenue for r in clean.before_after(result).orderBy(F.desc("stage")).collect()]
    assert all(v is not None and math.isfinite(v) for v in revenue)
    assert (revenue[0] >= 1e33) == representable
    lines = features.line_items(result.final)
    overview = sales.sales_overview(lines).first()
    assert overview.total_orders == 3 and math.isfinite(overview.total_revenue)
    assert features.invoice_summary(lines).count() == 3
    assert clean.impute(raw, dims).residual.count() == 3


def test_sums_with_huge_amounts_are_defined(spark):
    def total(*amounts):
        row = spark.createDataFrame([(a,) for a in amounts], "x double").agg(m.total(F.col("x")), m.exact_sum(F.col("x"))).first()
        return row[0], float(row[1])

    assert total(1e33, 1.5) == (1e33, 1e26)
    assert total(-1e33, 2e33) == (1e33, 1e26)
    assert total(float("inf"), float("nan"), 2.25) == (2.25, 2.25)
    assert total(999999999999999.5, 0.25, -0.125) == (999999999999999.625, 999999999999999.625)
    assert total(-0.0000005, -2.5) == (-2.500001, -2.500001)
    rows = spark.range(2000).select((F.lit(9.99e14) + F.col("id") / 4).alias("x")).repartition(7)
    assert rows.agg(m.exact_sum(F.col("x"))).first()[0] == sum(Decimal(999_000_000_000_000) + Decimal(i) / 4 for i in range(2000))


def test_quantities_at_both_ends_of_64_bits(spark):
    ends = [{"quantity": q, "invoice_id": "INV-2", "product_id": "p1", "line_no": q} for q in (101, 102, 103, 104)]
    extreme = F.when(F.col("quantity") == 103, -(2**63)).when(F.col("quantity") > 100, 2**63 - 1).otherwise(F.col("quantity"))
    lines = features.line_items(fact(spark, *ends).withColumn("quantity", extreme))
    assert sales.sales_overview(lines).first().total_units == 2**63 - 1  # nearest 64-bit value
    assert {r.invoice_id: r.order_quantity for r in features.invoice_summary(lines).collect()}["INV-2"] == 2**63 - 1
    goods = features.product_lines(lines, products(spark))
    assert {r.signed_quantity for r in features.profit_measures(goods.drop("signed_quantity", "units_sold", "units_returned", "cost_impact", "gross_profit", "profit_margin")).collect()} >= {2**63 - 1}
    shops = features.with_stores(goods, text_stores(spark))
    assert store.store_summary(shops).count() == 1
    assert spark.createDataFrame([(-(2**63),), (-5,), (None,)], "x long").select(m.magnitude(F.col("x"))).collect() == [(2**63 - 1,), (5,), (None,)]


def text_stores(spark, staff="5"):
    columns = ("store_id", "country", "city", "store_name", "number_of_employees", "zip_code", "latitude", "longitude")
    return spark.createDataFrame([("s1", "US", "NY", "Store NY", staff, "1", "n/a", "")], ", ".join(f"{c} string" for c in columns))


@pytest.mark.parametrize(("staff", "expected"), [("5", 5.0), ("unknown", 0.0), ("", 0.0), (None, 0.0)])
def test_text_masters_with_values_that_do_not_parse(spark, staff, expected):
    lines = features.line_items(fact(spark, {}, {"store_id": "UNKNOWN_STORE"}))
    stores = clean.final_stores(text_stores(spark, staff))
    assert stores.where("store_id = 'UNKNOWN_STORE'").first().number_of_employees is None
    shops = features.with_stores(features.product_lines(lines, clean.final_products(products(spark))), stores)
    for report in (store.store_summary, store.store_overview, store.top_stores_per_employee, store.productivity_by_employee_band, store.country_performance):
        report(shops).collect()
    assert {r.number_of_employees for r in store.store_summary(shops).collect()} == {expected}
    people = spark.createDataFrame(
        [("c1", "unknown", "NY"), ("c2", "1990-13-40", "NY"), ("c3", "1980-05-01", "LA"), ("c4", None, "LA")], "customer_id string, date_of_birth string, city string",
    ).withColumn("gender", F.lit("F"))
    aged = features.demographics(features.with_customers(lines, people), "2024-01-01")
    assert all(r.age is None or r.age > 40 for r in aged.collect())
    customer.revenue_by_age_group(lines, people, "2024-01-01").collect()


def test_ten_thousand_overlapping_campaigns_of_one_key(spark):
    rng = random.Random(8)
    base = date(2020, 1, 1)
    rows = []
    for i in range(10_000):
        start = base + timedelta(days=rng.randrange(1500))
        end = "9999-12-31" if i == 77 else str(start + timedelta(days=rng.choice([0, 1, 5, 40, 700])))
        rows.append((rng.randrange(9000), f"{start} 00:00:00", f"{end} 00:00:00", str(i % 90 / 100), "Tops", "Shirts", f"c{i}"))
    rows += [(1, "2020-02-01 00:00:00", "2020-01-01 00:00:00", "0.1", "Tops", "Caps", "backwards"), (2, "2020-02-01 09:00:00", "2020-02-01 18:00:00", "0.1", "Tops", "Caps", "within a day")]
    discounts = spark.createDataFrame(rows, "campaign_seq int, start string, end string, discount string, category string, sub_category string, description string")
    segments = features.campaign_segments(features.campaigns(discounts))
    found = [(r["first"], r["stop"], r.description, r.discount) for r in segments.collect()]
    assert len(found) < 2 * len(rows) and {r.sub_category for r in segments.collect()} == {"Shirts"}
    zero = date(1970, 1, 1)
    brute = {}
    for seq, start, end, rate, _, sub, name in sorted(rows[:10_000], key=lambda r: (r[0], r[1], r[2], r[6])):
        first = (date.fromisoformat(start[:10]) - zero).days
        for day in range(first, min((date.fromisoformat(end[:10]) - zero).days, first + 3000) + 1):
            brute[day] = name, float(rate)
    got = {}
    for first, stop, name, rate in found:
        for day in range(first, min(stop, first + 3000)):
            assert day not in got
            got[day] = name, rate
    inside = range((base - zero).days, (base - zero).days + 2300)
    assert [got.get(d) for d in inside] == [brute.get(d) for d in inside]
    parts = features.campaign_parts(segments).collect()
    assert len(parts) <= len(found) and max(len(r.stretches) for r in parts) <= max(r.width for r in parts)
    span = max(f[1] for f in found) - min(f[0] for f in found)
    assert max(len(r.stretches) for r in parts) <= 1.5 * math.sqrt(span)
