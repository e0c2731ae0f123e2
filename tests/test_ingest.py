from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_clean import DEFAULTS, dims  # noqa: F401
from tillsight.plans import pipeline
from tillsight.session import shared_dir, stage, staging_scope
from tillsight.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_clean_report(spark, dims, tmp_path):  # noqa: F811
    rows = [{**DEFAULTS, "invoice_id": f"INV-{i}", "date": f"2023-0{1 + i % 3}-05 10:00:00"} for i in range(6)]
    source = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in DEFAULTS)).drop("sku")
    source = source.withColumn("quantity", F.col("quantity").cast("int")).withColumn("extra", F.lit(1))
    offers = spark.createDataFrame(
        [("2023-01-01 00:00:00", "2023-12-31 00:00:00", "0.1", "Tops", "Shirts", "all year"), ("2023-02-01 00:00:00", "2023-02-28 00:00:00", "0.2", "Tops", "Shirts", "later")],
        "start string, end string, discount string, category string, sub_category string, description string",
    ).coalesce(1)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    pipeline.ingest(spark, source, offers, raw)
    landed = tables.load_table(spark, "transactions", raw)
    assert {t for n, t in landed.dtypes if n != "source_rowid"} == {"string"} and landed.select("source_rowid").distinct().count() == 6
    assert landed.filter("sku is null").count() == 6
    written = {r.description: r.campaign_seq for r in tables.load_table(spark, "discounts", raw).collect()}
    assert written["all year"] < written["later"]
    pipeline.clean_tables(landed, dims, out)
    tables.save_table(tables.load_table(spark, "discounts", raw), "discounts", out)
    final = tables.load_table(spark, "transactions_final", out)
    names = {"campaign_summary", "rfm", "cohort_matrix", "clv_tiers", "abc_classes", "unknown_store_split", "unknown_product_split"}
    done = pipeline.write_reports(final.drop("year", "month"), tables.load_dimensions(spark, out, "_final"), "2024-01-01", out, names)
    assert set(done) == names and tables.load_table(spark, "before_after", out).count() == 2


def test_a_period_prunes_the_partitions(spark, tmp_path):
    days = spark.sql("SELECT explode(sequence(date'2021-11-01', date'2023-02-28')) AS transaction_date")
    dated = days.withColumns({"year": F.year("transaction_date"), "month": F.month("transaction_date")})
    tables.save_table(dated.hint("rebalance", "year", "month"), "t", str(tmp_path), ("year", "month"))
    stored = tables.load_table(spark, "t", str(tmp_path))
    cut = pipeline.in_period(stored, "2021-12-15", "2022-01-03")
    assert cut.count() == 20 and cut.agg(F.min("transaction_date"), F.max("transaction_date")).first()[:] == (date(2021, 12, 15), date(2022, 1, 3))
    filters = next(line for line in plan(cut).splitlines() if "PartitionFilters" in line)
    assert "year" in filters and "month" in filters
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 2 * 16


def test_row_ids_need_no_exchange(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t"))
    frame = tables.with_source_rowid(spark, str(tmp_path / "t"))
    assert frame.select("source_rowid").distinct().count() == 10
    assert "Exchange hashpartitioning" not in plan(frame)


def test_views_catalog_tables_and_replacement(spark):
    tables.create_view(spark.range(3).toDF("n"), "three")
    assert spark.table("three").count() == 3
    for rows in (5, 2):  # the second write replaces the first
        tables.save_table(spark.range(rows).toDF("n"), "replaced_table")
        assert tables.load_table(spark, "replaced_table").count() == rows
    spark.sql("DROP TABLE replaced_table")


def test_staging_tables_go_with_their_scope(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/staging")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    with pytest.raises(ZeroDivisionError), staging_scope(spark):
        name = stage(spark.range(2).toDF("n"), "inside").inputFiles()[0].rsplit("/", 2)[1]
        raise ZeroDivisionError
    assert name.startswith("inside-") and name not in [f.getPath().getName() for f in system.listStatus(folder)]


def test_csv_files_from_ingest_to_reports(spark, tmp_path):
    """Text masters with values that do not parse pass every step of the command line."""
    files = {
        "transactions": [DEFAULTS, {**DEFAULTS, "invoice_id": "INV-9", "store_id": "-1"}],
        "discounts": [{"start": "2023-01-01", "end": "2023-12-31", "discount": "0.1", "category": "Tops", "sub_category": "Shirts", "description": "all year"}],
        "customers": [{"customer_id": c, "name": "n", "email": "e", "telephone": "t", "city": "NY", "country": "US", "gender": "F", "date_of_birth": d, "job_title": "j"}
                      for c, d in (("c1", "1990-05-01"), ("c2", "unknown"))],
        "products": [{"product_id": "p1", "category": "Tops", "sub_category": "Shirts", **{f"description_{x}": "d" for x in ("pt", "de", "fr", "es", "en", "zh")},
                      "color": "red", "size": "M", "production_cost": "n/a"}],
        "stores": [{"store_id": "s1", "country": "US", "city": "NY", "store_name": "One", "number_of_employees": "many", "zip_code": "1", "latitude": "", "longitude": "x"}],
        "employees": [{"employee_id": "e1", "store_id": "s1", "name": "n", "position": "p"}],
    }
    for name, rows in files.items():
        frame = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in rows[0]))
        frame.coalesce(1).write.option("header", "true").csv(f"{tmp_path}/files/{name}")
    steps = [["ingest", "--format", "csv", "--tables", f"{tmp_path}/files", "--out", f"{tmp_path}/raw"], ["clean", "--tables", f"{tmp_path}/raw", "--out", f"{tmp_path}/final"]]
    for step in steps:
        pipeline.main(step)
    tables.save_table(tables.load_table(spark, "discounts", f"{tmp_path}/raw"), "discounts", f"{tmp_path}/final")
    dims = tables.load_dimensions(spark, f"{tmp_path}/final", "_final")
    assert dict(dims.stores.dtypes)["number_of_employees"] == "double" and dict(dims.customers.dtypes)["date_of_birth"] == "date"
    final = tables.load_table(spark, "transactions_final", f"{tmp_path}/final").drop("year", "month")
    names = {"store_summary", "store_overview", "productivity_by_employee_band", "revenue_by_age_group", "product_ranking", "campaign_summary"}
    assert set(pipeline.write_reports(final, dims, "2024-01-01", f"{tmp_path}/reports", names)) == names
