from datetime import date

import pytest
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions import semantics as m
from tillsight.functions.bands import band, quartile_band


def values(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression.alias("y")).collect()]


def test_text_to_number_takes_the_numeric_prefix(spark):
    texts = ["N/A", "12abc", " 3.5 ", "1e3", ".5", "-2.7", "", "5.", "--1", "1-2", "NaN", "12d", None]
    assert values(spark, texts, m.to_real(F.col("x"))) == [0.0, 12.0, 3.5, 1000.0, 0.5, -2.7, 0.0, 5.0, 0.0, 1.0, 0.0, 12.0, None]
    assert values(spark, ["2.7", "1e3", "-2.7", "x", " 7 ", "5-"], m.to_int(F.col("x"))) == [2, 1, -2, 0, 7, 5]


def test_only_iso_moments_are_dates(spark):
    texts = ["2023-01-05", "2023-01-05 10:30", "2023-01-05T10:30:15", "2023", "2023-1-5", "2023/01/05", "2023-02-30", "2023-01-05 25:00:00"]
    day = date(2023, 1, 5)
    assert values(spark, texts, m.to_day(F.col("x"))) == [day, day, day] + [None] * 5


def test_rounding_is_half_away_from_zero(spark):
    assert values(spark, [2.675, 1.005, -0.005, 2.5], m.money(F.col("x")), "double") == [2.68, 1.01, -0.01, 2.5]
    assert values(spark, [2.5, -2.5], m.round_half_up(F.col("x"), 0), "double") == [3.0, -3.0]


def test_dirty_rules_by_column_class(spark):
    texts = [None, "", "  ", "N/A", "n/a", "unknown", "Unknown", "-1", "-1.0", "\t", "5"]

    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    for name, expected in {
        "invoice_id": [1, 1, 1, 1, 0, 1, 0, 0, 0, 0, 0],
        "customer_id": [1, 1, 1, 1, 0, 1, 0, 1, 0, 0, 0],
        "unit_price": [1, 1, 1, 0, 0, 1, 0, 1, 1, 0, 0],
    }.items():
        got = df.orderBy("i").select(F.col("v").alias(name)).select(m.is_dirty(s.RAW[name]).cast("int")).collect()
        assert [r[0] for r in got] == expected
        cleaned = df.orderBy("i").select(F.lit(0).alias("source_rowid"), F.col("v").alias(name))
        rules = [s.RAW[name]]
        got = m.typed(m.parsed(cleaned, rules), rules).select(F.col(name).isNull().cast("int")).collect()
        assert [r[0] for r in got] == expected
    price = df.select(F.col("v").alias("unit_price")).filter("unit_price = 'N/A'").select(m.clean_value(s.RAW["unit_price"])).first()
    assert price[0] == 0.0


def test_exact_sum_does_not_depend_on_order(spark):
    amounts = [0.1, 0.2, -0.3, 1e9, -1e9, 12.345678, -0.000001] * 200
    expected = pytest.approx(200 * (12.345678 - 0.000001))
    seen = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame([(a,) for a in amounts], "x double").repartition(parts)
        seen.add(df.agg(m.total(F.col("x"))).first()[0])
    assert len(seen) == 1 and seen.pop() == expected
    empty = spark.createDataFrame([], "x double").agg(m.total(F.col("x")), m.total_or_zero(F.col("x")), m.mean(F.col("x"))).first()
    assert tuple(empty) == (None, 0.0, None)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(m.pearson(F.col("x"), F.col("y")), m.pearson(F.col("y"), F.col("y"))).first()[0] is None
    assert df.agg(m.ratio(F.lit(1), F.lit(0)), m.ratio_or_zero(F.lit(1), F.lit(0))).first()[:] == (None, 0.0)


def test_bands_are_right_closed(spark):
    rates = [-0.5, -0.00005, 0.0, 0.1, 0.3, 0.5, 1.0, 1.2]
    assert values(spark, rates, band(F.col("x"), s.DISCOUNT_BANDS), "double") == [
        None, "No Discount", "No Discount", "Low", "Medium", "High", "Very High", None
    ]
    counts = [-1, 0, 1, 3, 5, 10, 11]
    assert values(spark, counts, band(F.col("x"), s.BASKET_BANDS, include_lowest=True), "int") == [
        None, "1 item", "1 item", "2-3 items", "4-5 items", "6-10 items", "10+ items"
    ]


@pytest.mark.parametrize("prices, expected", [
    ([1.0, 2.0, 3.0, 4.0, 5.0], ["a", "a", "b", "c", "d"]),
    ([1.0, 1.0, 1.0, 1.0, 5.0], ["a", "a", "a", "a", "d"]),  # tied edges: four equal widths
    ([7.0, 7.0], ["b", "b"]),
])
def test_quartile_bands(spark, prices, expected):
    df = spark.createDataFrame([(p,) for p in prices], "p double")
    got = quartile_band(df, "p", ("a", "b", "c", "d"), "label").orderBy("p").collect()
    assert [r.label for r in got] == expected
