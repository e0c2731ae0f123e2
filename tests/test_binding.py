"""The binding of lines: what moves while they are landed, and odd keys."""

import datetime

import pytest

from tests.compare import DATA
from tillsight.sources import fixtures
from tillsight.sources.fixtures import Fixture


def exchanges(plan):
    """Names of the columns that each exchange of a plan moves."""
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    own = [{plan.output().apply(i).name() for i in range(plan.output().size())}] if plan.nodeName() == "Exchange" else []
    return own + [found for i in range(plan.children().size()) for found in exchanges(plan.children().apply(i))]


@pytest.mark.parametrize("table", ["raw", "fact"])
def test_landing_moves_lines_twice_and_before_they_are_text(spark, monkeypatch, table):
    monkeypatch.setattr(fixtures, "_LANDED", {})
    plans = []
    monkeypatch.setattr(fixtures, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan()) or df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        getattr(Fixture(spark, str(DATA / "sf0.001")), table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = exchanges(plans[0])
    assert len([columns for columns in moved if "source_rowid" in columns]) == 2
    assert not [columns for columns in moved if columns & {"invoice_id", "transaction_datetime", "sku", "store_id", "line_total"}]


def test_repeated_and_missing_keys_are_bound_as_plain_joins_do(spark, tmp_path):
    day = datetime.datetime(1996, 3, 2)
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"
    rows = [
        (1, 1, 5, 1, 3.0, 10.0, 0.01, "N", day), (1, 2, 6, 1, 4.0, 11.0, 0.02, "R", day), (1, 3, 5, 1, None, 12.0, 0.03, None, day),
        (2, 1, 5, 1, 3.0, 10.0, 0.01, "A", day), (2, 2, None, 1, 1.0, 1.0, 0.0, "N", day), (None, 1, 5, 1, 1.0, 1.0, 0.0, "N", day),
        (3, 1, 5, 1, 1.0, 1.0, 0.0, "N", day), (2, 4, 9, 1, 1.0, 1.0, 0.0, "N", day),
    ]
    tables = {
        "lineitem": (rows, line),
        "orders": ([(1, 7, "F", day), (1, 8, "O", day), (2, None, None, None), (None, 7, "F", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "part": ([(5, "red thing", 4, 100.0), (5, "blue thing", 5, 50.0), (6, None, None, None), (None, "x", 1, 1.0)], "p_partkey long, p_name string, p_size int, p_retailprice double"),
        "supplier": ([(1,), (2,)], "s_suppkey long"),
    }
    for name, (values, kinds) in tables.items():
        spark.createDataFrame(values, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = Fixture(spark, str(tmp_path)).fact.select("invoice_id", "line_no", "product_id", "color", "customer_id", "line_total", "invoice_total", "store_id", "transaction_datetime").collect()
    # Order 1 and part 5 come twice, so line 1 counts four times in its total: units 4, less 6 percent, at 150 and at 100.
    sold = 2 * (564.0 + 376.0)
    assert sorted(map(tuple, found), key=repr) == sorted([
        *[("INV-1", 1, "5", color, customer, amount, sold, "1", "1996-03-02 01:00:00") for color, amount in (("red", 564.0), ("blue", 376.0)) for customer in ("7", "8")],
        *[("RET-1", 2, "6", None, customer, None, None, "1", "1996-03-02 01:00:00") for customer in ("7", "8")],
        *[("INV-1", 3, "5", color, customer, None, sold, "1", "1996-03-02 01:00:00") for color in ("red", "blue") for customer in ("7", "8")],
        *[("INV-2", 1, "5", color, None, amount, 940.0, "0", None) for color, amount in (("red", 564.0), ("blue", 376.0))],
    ], key=repr)
