import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillsight.functions import selection
from tillsight.functions.ranking import row_numbers, running_total
from tillsight.functions.selection import quantiles, tiers
from tillsight.functions.skew import join_back


@pytest.mark.parametrize("n", [1, 4, 5, 7, 101])
def test_tiers_equal_first_rank_quantile_bins(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"k": [f"{i:05d}" for i in range(n)], "v": rng.integers(0, max(2, n // 3), n).astype(float)})
    got = tiers(spark.createDataFrame(frame).repartition(5), "v", "k", 5, "tier").orderBy("k").toPandas()
    if n >= 5:
        expected = pd.qcut(frame["v"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    else:
        rank = frame["v"].rank(method="first").astype(int)
        expected = [max(1, -(-(r - 1) * 5 // max(n - 1, 1))) for r in rank]
    assert got["tier"].tolist() == list(expected)


def test_tiers_split_a_value_held_by_most_rows(spark):
    df = spark.range(3000).select(F.lpad("id", 5, "0").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).cast("double").alias("v"))
    sizes = {r.tier: r["count"] for r in tiers(df, "v", "k", 4, "tier").groupBy("tier").count().collect()}
    assert sizes == {1: 750, 2: 750, 3: 750, 4: 750}


def test_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(100, 30, 997), 2), rng.integers(1, 9, 500).astype(float)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    df = spark.createDataFrame(rows, "metric string, value double").repartition(7)
    points = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {r.metric: r.quantiles for r in quantiles(df, points).collect()}
    assert got["a"] == pytest.approx(list(np.quantile(a, points)))
    assert got["b"] == pytest.approx(list(np.quantile(b, points)))


def test_running_total_crosses_slices(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("decimal(20,6)").alias("m")).repartition(6)
    got = running_total(df, [F.desc("id")], F.col("m"), "total").orderBy(F.desc("id")).toPandas()
    expected = np.cumsum([i % 7 for i in range(999, -1, -1)])
    assert [int(x) for x in got["total"]] == expected.tolist()


def test_row_numbers_continue_over_slices_of_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"), "id")
        got = row_numbers(df.repartition(5), "g", "id").toPandas().sort_values("id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["row_number"].tolist() == (got.groupby("g").cumcount() + 1).tolist()


def test_join_back_splits_a_hot_key_and_keeps_null_keys(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        key = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
        rows = spark.range(0, 30000, 1, 6).select("id", key.alias("k"))
        summary = rows.groupBy("k").agg(F.count("*").alias("n"))
        joined = join_back(rows, summary.filter("k IS NOT NULL"), ["k"], spread="id")
        result = joined.agg(F.count("*").alias("rows"), F.count("n").alias("found"), F.max("n").alias("largest"))
        assert tuple(result.first()) == (30000, 27000, 9000)
        collected = joined.select("id", "n")
        collected.collect()
        assert "skew=true" in collected._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


@pytest.fixture
def small_windows(monkeypatch):
    """Bounds so small that a few thousand rows take several rounds."""
    monkeypatch.setattr(selection, "INSIDE", 20)
    monkeypatch.setattr(selection, "ACCURACY", 25)


def test_selection_in_many_rounds(spark, small_windows):
    rng = np.random.default_rng(5)
    n = 4000
    frame = pd.DataFrame({
        "k": [f"customer-{i:05d}" for i in rng.permutation(n)], "wide": rng.normal(0, 1e9, n), "tied": rng.choice([1.0, 1.0, 1.0, 2.0, 7.5], n),
        "steep": 10.0 ** rng.uniform(-300, 300, n), "same": np.full(n, 3.0), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 50, n)),
    })
    df = spark.createDataFrame(frame).withColumn("gaps", F.nanvl("gaps", F.lit(None).cast("double"))).repartition(6)
    names = ("wide", "tied", "steep", "same", "gaps")
    positions = (1, 2, 777, 2000, 2001, 2700)
    for key in (None, "k"):
        wanted = [(c, p) for c in range(len(names)) for p in positions if p <= frame[names[c]].count()]
        got = selection.at_positions(df, [F.col(c) for c in names], wanted, key=key)
        for (c, p), answer in zip(wanted, got, strict=True):
            ordered = frame.dropna(subset=[names[c]]).sort_values([names[c], "k"]).iloc[p - 1]
            assert answer == (ordered[names[c]], ordered["k"] if key else None), (names[c], p)


def test_tiers_and_quantiles_in_many_rounds(spark, small_windows):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"k": [f"{i:04d}" for i in rng.permutation(2500)], "v": rng.choice([0.0, 0.0, 5.0, *range(400)], 2500).astype(float)})
    df = spark.createDataFrame(frame).repartition(4)
    got = tiers(df, "v", "k", 5, "tier").toPandas().sort_values(["v", "k"])["tier"].tolist()
    assert got == [max(1, -(-r * 5 // 2499)) for r in range(2500)]
    assert tiers(df.limit(0), "v", "k", 5, "tier").count() == 0
    measured = df.select((F.col("k").cast("int") % 2).alias("metric"), F.col("v").alias("value"))
    points = (0.0, 0.1, 0.5, 0.9, 1.0)
    for r in quantiles(measured, points).collect():
        assert r.quantiles == pytest.approx(list(np.quantile(frame["v"][frame["k"].astype(int) % 2 == r.metric], points)))
    assert quantiles(measured.limit(0), points).count() == 0


def test_selection_plans_neither_a_range_sort_nor_a_stored_copy(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: pytest.fail("a copy is stored"))
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.rand(3).alias("v"))
    assert "rangepartitioning" not in tiers(df, "v", "k", 4, "tier")._jdf.queryExecution().executedPlan().toString()
