from datetime import date

from tillsight.operators import customer, discount, features, product, sales, store

FACT = (
    "source_rowid long, invoice_id string, line_no int, customer_id string, product_id string, size string, color string, "
    "unit_price double, quantity int, transaction_datetime string, transaction_date date, discount double, line_total double, "
    "store_id string, employee_id string, transaction_type string, payment_method string"
)


def fact(spark, *lines):
    base = dict(
        invoice_id="INV-1", line_no=1, customer_id="c1", product_id="p1", size="M", color="red", unit_price=10.0, quantity=2,
        transaction_datetime="2023-01-05 10:00:00", transaction_date=date(2023, 1, 5), discount=0.0, line_total=20.0,
        store_id="s1", employee_id="e1", transaction_type="Sale", payment_method="Cash",
    )
    names = [c.split(" ")[0] for c in FACT.split(", ")][1:]
    return spark.createDataFrame([(i, *[{**base, **line}[n] for n in names]) for i, line in enumerate(lines, 1)], FACT)


def products(spark):
    return spark.createDataFrame(
        [("p1", "Tops", "Shirts", "shirt", "red", "M", "4.0"), ("p2", "Hats", "Caps", "cap", "blue", "S", "30.0")],
        "product_id string, category string, sub_category string, description_en string, color string, size string, production_cost string",
    )


def test_campaign_of_a_day_is_the_last_listed_one(spark):
    discounts = spark.createDataFrame([
        (1, "2023-01-01 00:00:00", "2023-01-05 00:00:00", "0.1", "Tops", "Shirts", "first"),
        (2, "2023-01-05 00:00:00", "2023-01-06 00:00:00", "0.2", "Tops", "Shirts", "second"),
        (3, "2023-01-07 08:00:00", "2023-01-08 00:00:00", "0.3", "Tops", "Shirts", "starts at eight"),
        (4, "2023-01-01 00:00:00", "2023-12-31 00:00:00", "0.4", None, "Shirts", "no category"),
        (5, "2023-01-09 00:00:00", "2023-01-02 00:00:00", "0.5", "Tops", "Shirts", "backwards"),
    ], "campaign_seq int, start string, end string, discount string, category string, sub_category string, description string")
    days = [date(2022, 12, 31), date(2023, 1, 1), date(2023, 1, 5), date(2023, 1, 6), date(2023, 1, 7), date(2023, 1, 8)]
    lines = features.line_items(fact(spark, *[{"transaction_date": d, "discount": 0.1} for d in days]))
    got = features.discount_lines(lines, products(spark), discounts).orderBy("transaction_date").collect()
    assert [r.campaign_description for r in got] == ["No Campaign", "first", "second", "second", "No Campaign", "starts at eight"]
    assert [r.discount_status for r in got][:2] == ["Non-Campaign Discount", "Campaign Discount"]


OFFERS = "campaign_seq int, start string, end string, discount string, category string, sub_category string, description string"


def test_campaigns_of_masters_and_lines_without_attributes(spark):
    discounts = spark.createDataFrame([
        (1, "2023-01-01 00:00:00", "2023-01-05 00:00:00", "0.1", "Unknown", "Unknown", "clearance"),
        (2, "2023-01-05 00:00:00", "2023-01-06 00:00:00", "0.2", "Tops", "Unknown", "tops"),
        (3, "2024-06-01 00:00:00", "2024-06-30 00:00:00", "0.2", "Tops", "Unknown", "late"),
    ], OFFERS)
    masters = products(spark).unionByName(spark.createDataFrame(
        [("p3", None, None, "x", "red", "M", "1.0"), ("p4", "Tops", None, "y", "red", "M", "1.0")], products(spark).schema
    ))
    sold = [(p, date(y, m, d)) for p in ("p1", "p3", "p4", "p9", None) for y, m, d in ((2022, 12, 1), (2023, 1, 5), (2023, 6, 1), (2024, 6, 7), (2050, 1, 1))]
    lines = features.line_items(fact(spark, *[{"product_id": p, "transaction_date": d} for p, d in sold]))
    want = {(p, date(2023, 1, 5)): "clearance" for p in ("p3", "p9", None)} | {("p4", date(2023, 1, 5)): "tops", ("p4", date(2024, 6, 7)): "late"}
    with_goods = features.with_campaigns(features.product_lines(lines, masters), discounts)
    for found in (features.discount_lines(lines, masters, discounts), with_goods):
        assert {(r.product_id, r.transaction_date): r.campaign_description for r in found.collect()} == {k: want.get(k, "No Campaign") for k in sold}
        assert {r.product_id for r in found.filter("is_campaign_period").collect()} == {"p3", "p4", "p9", None}


def test_campaigns_move_lines_once_by_product_and_once_by_part(spark):
    import re

    discounts = spark.createDataFrame([(1, "2023-01-01 00:00:00", "2023-01-05 00:00:00", "0.1", "Tops", "Shirts", "first")], OFFERS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        goods = features.discount_lines(features.line_items(fact(spark, {})), products(spark), discounts)
        query = discount.campaign_summary(goods)._jdf.queryExecution()
        plan = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [columns for columns in re.findall(r"Exchange\s+Input \[\d+\]: \[([^\]]*)\]", plan) if "transaction_date" in columns]
    assert len(moved) == 2 and not any("source_rowid" in columns for columns in moved)


def test_returns_turn_revenue_and_profit_negative(spark):
    lines = features.line_items(fact(spark, {}, {"transaction_type": " return ", "line_no": 2}, {"unit_price": None}))
    goods = {r.source_rowid: r for r in features.product_lines(lines, products(spark)).collect()}
    assert set(goods) == {1, 2}
    assert (goods[1].revenue, goods[2].revenue, goods[2].gross_profit, goods[2].units_returned) == (20.0, -20.0, -12.0, 2)


def test_loss_makers_push_the_abc_share_above_one(spark):
    lines = features.product_lines(features.line_items(fact(
        spark, {"line_total": 100.0}, {"product_id": "p2", "transaction_type": "Return", "line_total": 20.0}
    )), products(spark))
    shares = {r.product_id: (r.cumulative_revenue_share, r.abc_class) for r in product.abc_classes(lines).collect()}
    assert shares == {"p1": (1.25, None), "p2": (1.0, "C")}


def test_empty_tables_give_empty_or_zero_reports(spark):
    lines = features.line_items(fact(spark, {}).filter("false"))
    overview = sales.sales_overview(lines).first()
    assert (overview.total_revenue, overview.total_orders, overview.aov) == (0.0, 0, 0.0)
    assert sales.order_revenue_histogram(lines).count() == 0
    assert customer.cohort_retention(lines).count() == 0
    goods = features.product_lines(lines, products(spark))
    assert product.product_overview(goods).first().active_products == 0


def test_cohorts_count_from_the_first_positive_purchase(spark):
    lines = features.line_items(fact(
        spark,
        {"customer_id": "a", "transaction_date": date(2022, 12, 1), "transaction_type": "Return"},
        {"customer_id": "a", "transaction_date": date(2023, 1, 31)},
        {"customer_id": "a", "transaction_date": date(2023, 3, 1)},
        {"customer_id": "b", "transaction_date": date(2023, 1, 2)},
        {"customer_id": "unknown_customer", "transaction_date": date(2020, 1, 2)},
    ))
    got = {(r.cohort_month, r.cohort_index): (r.customers, r.retention) for r in customer.cohort_retention(lines).collect()}
    assert got == {("2023-01", 1): (2, 1.0), ("2023-01", 3): (1, 0.5)}


def test_report_totals_do_not_depend_on_partitioning(spark):
    table = fact(spark, *[{"invoice_id": f"INV-{i % 7}", "line_total": i * 0.1, "product_id": f"p{i % 3}"} for i in range(60)])
    seen = set()
    for parts in (1, 4, 9):
        lines = features.product_lines(features.line_items(table.repartition(parts)), products(spark))
        seen.add(tuple(tuple(r) for r in product.category_performance(lines).orderBy("category").collect()))
    assert len(seen) == 1


def test_first_category_wins_a_revenue_tie(spark):
    stores = spark.createDataFrame([("s1", "US", "NY", "Store NY", 0, "1")], "store_id string, country string, city string, store_name string, number_of_employees int, zip_code string")
    lines = features.store_lines(features.line_items(fact(spark, {}, {"product_id": "p2"})), products(spark), stores)
    assert store.top_category_by_store(lines).first().category == "Hats"
    assert store.productivity_by_employee_band(lines).first().employee_band == "1-5"


def test_prepared_sales_have_all_groups(spark):
    lines, invoices = features.prepare_sales(fact(spark, {}, {"line_no": 2, "unit_price": 30.0}, {"invoice_id": "INV-2", "line_total": 90.0, "quantity": 12}))
    assert {"price_segment"} <= set(lines.columns) and lines.filter("price_segment is null").count() == 0
    got = {r.invoice_id: (r.basket_size_group, r.order_value_group, r.avg_item_per_order) for r in invoices.collect()}
    assert got["INV-2"] == ("10+ items", "Very High Value", 7.5) and got["INV-1"][:2] == ("4-5 items", "Low Value")


def test_dictionary_lists_every_raw_column():
    from tillsight.schema import RAW_COLUMNS
    from tillsight.sources.tables import data_dictionary

    assert [name for name, _ in data_dictionary()] == [c.name for c in RAW_COLUMNS] and all(meaning for _, meaning in data_dictionary())
