import pytest
from pyspark.sql import functions as F

from tillsight.operators import clean, profile
from tillsight.schema import RAW
from tillsight.sources.tables import Dimensions

DEFAULTS = dict(
    invoice_id="INV-1", line_no="1", customer_id="c1", product_id="12", size="M", color="red", unit_price="10.0",
    quantity="2", date="2023-01-05 10:00:00", discount="0.0", line_total="20.0", store_id="s1", employee_id="e1",
    currency="USD", currency_symbol="$", sku="AB12C34", transaction_type="Sale", payment_method="Cash", invoice_total="20.0",
)


def raw_table(spark, *lines):
    rows = [(i, *[{**DEFAULTS, **line}[c] for c in RAW]) for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "source_rowid long, " + ", ".join(f"{c} string" for c in RAW))


@pytest.fixture(scope="module")
def dims(spark):
    text = "description_pt string, description_de string, description_fr string, description_es string, description_en string, description_zh string"
    return Dimensions(
        customers=spark.createDataFrame([("c1", *["x"] * 6, None, "x")], "customer_id string, name string, email string, telephone string, city string, country string, gender string, date_of_birth date, job_title string"),
        products=spark.createDataFrame([("12", "Tops", "Shirts", *["shirt"] * 6, "blue", None, 4.0)], f"product_id string, category string, sub_category string, {text}, color string, size string, production_cost double"),
        stores=spark.createDataFrame([("s1", "US", "NY", "Store NY", 5, "1", None, None)], "store_id string, country string, city string, store_name string, number_of_employees int, zip_code string, latitude double, longitude double"),
        employees=spark.createDataFrame([("e1", "s1", "Ann", "Seller")], "employee_id string, store_id string, name string, position string"),
    )


def by_id(df):
    return {r.source_rowid: r for r in df.collect()}


def test_clean_and_rejected_rows_cover_the_raw_table(spark):
    raw = raw_table(spark, {}, {"unit_price": "unknown"}, {"date": ""}, {"invoice_id": "N/A"}, {"line_total": "-1", "discount": "0.1"}, {"customer_id": " "})
    kept, rejected = by_id(clean.clean_rows(raw)), by_id(clean.rejected_rows(raw))
    assert set(kept) == {1, 5, 6} and set(rejected) == {2, 3, 4}
    assert kept[5].line_total == 18.0 and kept[6].customer_id == "UNKNOWN_CUSTOMER"


def test_values_are_filled_from_invoice_sku_masters_and_sibling_sale(spark, dims):
    raw = raw_table(
        spark,
        {"customer_id": "c7", "invoice_id": "INV-7", "invoice_total": "40.0"},
        {"customer_id": "", "invoice_id": "INV-7", "invoice_total": "40.0", "line_no": "-1", "payment_method": "unknown"},
        {"customer_id": "N/A", "invoice_id": "ret-7", "transaction_type": "Return", "line_total": "-20.0", "invoice_total": "-1"},
        {"invoice_id": "INV-8", "product_id": "unknown", "sku": "AB12C34", "color": "N/A", "store_id": "", "invoice_total": "20.0"},
        {"invoice_id": "INV-9", "product_id": "unknown", "sku": "X99", "invoice_total": "20.0"},
        {"invoice_id": "INV-10", "employee_id": "", "store_id": ""},
        {"invoice_id": None},
    )
    rows = by_id(clean.final_transactions(clean.impute(raw, dims).imputed))
    assert rows[2].customer_id == "c7" and rows[2].line_no == 2 and rows[2].payment_method == "Cash"
    assert rows[3].customer_id == "c7" and rows[3].invoice_total == -20.0
    assert (rows[4].product_id, rows[4].color, rows[4].store_id) == ("12", "blue", "s1")
    assert rows[5].product_id == "UNKNOWN_PRODUCT" and rows[5].has_product_id == 0
    assert rows[6].employee_id == "UNKNOWN_STORE_UNKNOWN" and rows[6].store_id == "UNKNOWN_STORE"
    assert 7 not in rows


def test_amounts_are_solved_from_the_line_total(spark, dims):
    raw = raw_table(
        spark,
        {"invoice_id": "INV-1", "unit_price": "", "quantity": "4", "line_total": "30.0", "discount": "0.25"},
        {"invoice_id": "INV-2", "quantity": "unknown", "unit_price": "10.0", "line_total": "30.0"},
        {"invoice_id": "INV-3", "discount": "-1", "unit_price": "10.0", "quantity": "4", "line_total": "30.0"},
        {"invoice_id": "INV-4", "quantity": "-1", "unit_price": "10.0", "line_total": "25.0"},
        {"invoice_id": "INV-5", "unit_price": "N/A", "line_total": "20.0"},
        {"invoice_id": "INV-6", "line_total": "", "transaction_type": "Return"},
    )
    rows = by_id(clean.final_transactions(clean.impute(raw, dims).imputed))
    assert (rows[1].unit_price, rows[2].quantity, rows[3].discount) == (10.0, 3, 0.25)
    assert rows[4].quantity == 2  # no whole number solves it, so the product's usual quantity
    assert rows[5].unit_price == 0.0 and rows[6].line_total == -20.0


def test_a_single_gap_is_closed_by_the_invoice_total(spark, dims):
    gap = {"product_id": "unknown", "sku": "", "unit_price": "", "line_total": ""}
    raw = raw_table(
        spark,
        {"invoice_id": "INV-1", "invoice_total": "50.0"}, {"invoice_id": "INV-1", "invoice_total": "50.0", **gap},
        {"invoice_id": "INV-2", "invoice_total": "50.0", **gap}, {"invoice_id": "INV-2", "invoice_total": "50.0", **gap},
        {"invoice_id": "INV-3", "invoice_total": "50.0"}, {"invoice_id": "INV-3", "invoice_total": "60.0", **gap},
    )
    stages = clean.impute(raw, dims)
    residual = {k: r.line_total_from_invoice_residual for k, r in by_id(stages.residual).items()}
    assert residual == {1: None, 2: 30.0, 3: None, 4: None, 5: None, 6: None}
    final = by_id(clean.final_transactions(stages.imputed))
    assert final[2].line_total == 30.0 and final[3].line_total == 0.0


def test_no_known_quantity_keeps_all_rows(spark, dims):
    raw = raw_table(spark, {"quantity": "", "line_total": "", "unit_price": "10.0"})
    final = by_id(clean.final_transactions(clean.impute(raw, dims).imputed))
    assert final[1].quantity == 2 and final[1].line_total == 20.0  # from the invoice residual of 20


def test_exact_copies_keep_the_smallest_row_id(spark):
    raw = raw_table(spark, {}, {}, {"line_no": "2"})
    assert {r.source_rowid for r in clean.drop_exact_duplicates(raw).collect()} == {1, 3}


def test_orphans_and_unknown_members(spark, dims):
    raw = raw_table(spark, {"customer_id": ""}, {"store_id": "s9"})
    before = {(r.field, r.invalid_value, r.cnt) for r in clean.orphan_keys(clean.clean_rows(raw), dims).collect()}
    assert before == {("customer_id", "UNKNOWN_CUSTOMER", 1), ("store_id", "s9", 1)}
    final = clean.final_transactions(clean.impute(raw, dims).imputed)
    after = {(r.field, r.invalid_value) for r in clean.orphan_keys(final, clean.final_dimensions(dims)).collect()}
    assert after == {("store_id", "s9")}


def test_profile_of_a_small_table(spark):
    raw = raw_table(spark, {}, {"line_total": "25.0"}, {"customer_id": "c2"}, {"discount": "1.5"}, {"payment_method": " "})
    accuracy = profile.line_total_accuracy(raw).first()
    assert (accuracy.total_rows, accuracy.possible_inaccurate_line_total_rows) == (5, 2)
    assert profile.invoice_consistency(raw).first().invoices_with_multiple_customers == 1
    assert profile.duplicate_line_numbers(raw).first().duplicate_rows == 5
    invalid = {(r.field_name, r.invalid_value) for r in profile.invalid_domain_values(raw).collect()}
    assert invalid == {("discount", "1.5"), ("payment_method", "[blank]")}
    worst = profile.completeness(raw).first()
    assert (worst.column_name, worst.missing_or_dirty_rows, worst.missing_or_dirty_pct) == ("payment_method", 1, 20.0)
    assert profile.line_total_accuracy(raw.filter("false")).select(F.col("possible_inaccurate_line_total_rows")).first()[0] is None
