"""What is moved and written: columns, copies and shuffle files that no later step needs."""

import re

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from tests.test_binding import exchanges
from tests.test_clean import dims, raw_table  # noqa: F401
from tillsight.functions.members import FEW, among, key_words, likely
from tillsight.functions.skew import join_back
from tillsight.operators import clean, features, store
from tillsight.session import stage_lines
from tillsight.sources import fixtures
from tillsight.sources.fixtures import Fixture

SMALL = str(DATA / "sf0.001")


@pytest.fixture
def large(spark):
    """Plans as for tables too large to broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_lines_are_written_small(spark):
    stored = stage_lines(spark.range(1000).select("id", F.lit("text").alias("word")), "some_lines")
    assert all(".zstd." in name for name in stored.inputFiles()) and stored.count() == 1000


def test_the_hash_beside_a_key_is_short(spark, large):
    rows = spark.range(100_000).select((F.col("id") % 50_000).alias("k"), "id")
    joined = join_back(rows, rows.select("k").distinct().withColumn("v", F.col("k") + 1), ["k"])
    found = re.search(r"pmod\(xxhash64\([^)]*\), (\d+)\)", plan(joined))
    assert found and int(found[1]) <= 1 << 16
    assert joined.filter(F.col("v") == F.col("k") + 1).count() == 100_000


def test_distinct_counts_of_stores_do_not_join_products(spark, large):
    tables = Fixture(spark, SMALL)
    lines = features.store_lines(features.line_items(tables.fact), tables.products, tables.stores)
    text = plan(store.store_summary(lines))
    assert text.count("part.parquet") == 1 and text.count("supplier.parquet") == 4


def test_stores_and_products_with_repeated_keys_give_the_same_lines(spark):
    lines = spark.createDataFrame([("s1", "p1", 1), ("s2", "p1", 2), (None, None, 3)], "store_id string, product_id string, n int")
    stores = spark.createDataFrame([("s1", "A", "X", "Y", "1", "5"), ("s1", "B", "X", "Y", "1", "6")], "store_id string, store_name string, country string, city string, zip_code string, number_of_employees string")
    products = spark.createDataFrame([("p1", "c", "d", "e", "f", "g", "1.5"), ("p1", "c", "d", "e2", "f", "g", "2")], "product_id string, category string, sub_category string, description_en string, color string, size string, production_cost string")
    amounts = lines.withColumns({"is_return": F.lit(False), "quantity": F.lit(1), "revenue": F.lit(2.0)})
    found = features.store_lines(amounts, products, stores)
    other = features.with_stores(features.product_lines(amounts, products), stores)
    assert sorted(map(repr, found.select(*sorted(found.columns)).collect())) == sorted(map(repr, other.select(*sorted(other.columns)).collect()))
    assert found.count() == 7


def test_rows_of_few_keys_are_picked_before_they_move(spark, large):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 5000).cast("string").alias("k"), "id")
    others = spark.createDataFrame([("11",), ("11",), (None,), ("4999",), ("x",)], "k string")
    found = {r.id for r in among(rows, "k", others).collect()}
    assert found == {r.id for r in rows.join(others.distinct(), "k", "left_semi").collect()} and len(found) == among(rows, "k", others).count() > 0
    assert likely(rows, "k", key_words(others, "k", FEW), FEW).count() < 100
    text = plan(among(rows, "k", others))
    assert "LeftSemi" not in text and 0 < text.rindex("bit_get") < text.rindex("Range (0, 20000")
    assert text.index("SortMergeJoin") < text.index("bit_get")


def test_modes_of_a_product_in_one_pass(spark):
    rows = [("a", 2.0, 1), ("a", 3.0, 1), ("a", 2.0, 5), ("a", 3.0, 5), ("a", None, -4), ("a", None, -4), ("a", None, -4), ("b", None, 3), ("c", 1.5, None), ("d", None, None), (None, 1.0, 1)]
    histogram = clean.sale_histogram(spark.createDataFrame(rows, "product_id string, unit_price double, quantity long"))
    found = {tuple(r) for r in clean.product_modes(histogram).collect()}
    assert found == {("a", 3.0, 1), ("b", None, 3), ("c", 1.5, None)}
    prices, quantities = ({tuple(r) for r in f(histogram).collect()} for f in (clean.price_modes, clean.quantity_modes))
    assert prices == {(p, x) for p, x, _ in found if x} and quantities == {(p, x) for p, _, x in found if x}


def test_only_lines_that_lack_something_move_whole(spark, dims, large, monkeypatch):  # noqa: F811
    moved, staged = {}, clean.stage

    def watched(df, name):
        moved[name] = exchanges(df._jdf.queryExecution().executedPlan())
        return staged(df, name)

    monkeypatch.setattr(clean, "stage", watched)
    raw = raw_table(spark, {"customer_id": ""}, {"invoice_id": "RET-1", "customer_id": ""}, {"product_id": "", "color": ""}, {"line_no": ""}, {"unit_price": "", "line_total": ""}, {})
    done = {r.source_rowid: r for r in clean.impute(raw, dims).imputed.collect()}
    assert [done[i].customer_id for i in range(1, 7)] == ["c1"] * 6
    assert (done[3].product_id, done[3].color, done[4].line_no, done[5].unit_price) == ("12", "blue", 3, 10.0)
    whole = {name: len([columns for columns in found if {"sku", "payment_method"} <= columns]) for name, found in moved.items()}
    assert whole["invoice_families"] == whole["lines_without_product_values"] == 1
    assert not any(whole[name] for name in whole if name not in ("invoice_families", "lines_without_product_values", "incomplete_lines"))


def test_copies_are_counted_from_the_digests_of_copies(spark, dims, monkeypatch):  # noqa: F811
    monkeypatch.setattr(clean, "BATCH", 3)
    lines = [{"line_no": str(n)} for n, copies in ((1, 1), (2, 2), (3, 4), (4, 8)) for _ in range(copies)]
    staged, stage = {}, clean.stage
    monkeypatch.setattr(clean, "stage", lambda df, name: staged.setdefault(name, df) and stage(df, name))
    result = clean.cleaned(raw_table(spark, *lines), dims)
    found = {r.stage: r.duplicate_rows for r in clean.before_after(result).collect()}
    assert found == {"before": 11, "after": 11} and result.before.digests.count() == 11
    assert not [name for name, df in staged.items() if {"has_quantity", "sku"} <= set(df.columns)]
    summary = {r.metric: r.value for r in clean.cleaning_summary(result, dims).collect()}
    assert summary == {"raw_rows": 15, "final_rows": 15, "invalid_foreign_key_rows": 0} and staged["final_keys"].columns == list(clean.KEYS)


def test_packed_cents_are_those_of_the_line(spark):
    rows = spark.range(1).selectExpr("explode(array(-10, -1, 0, 7, 12, null)) AS quantity").selectExpr("quantity", "explode(array(-5, 0, 1, 2, 7, null)) AS l_linenumber")
    rows = rows.selectExpr("*", "explode(array(-600, 0, 18, 60, 100, 1200, null)) AS discount_percent").selectExpr("*", "explode(array(true, false)) AS is_return")
    rows = rows.selectExpr("*", "explode(array(0D, 901.07D, -3.5D, null)) AS p_retailprice").selectExpr("*", f"{fixtures.PACKED} AS packed")
    signed = f"if(packed & 1L = 1, -1L, 1L) * ({fixtures.PACKED_CENTS})"
    assert rows.filter(f"NOT (({signed}) <=> ({fixtures.SIGNED_CENTS}))").count() == 0
    assert rows.filter("packed IS NOT NULL AND (packed & 1L = 1) <> is_return").count() == 0 and rows.filter(f"{fixtures.SIGNED_CENTS} <> 0").count() > 500
