"""All reports from one scan of the fact table."""

from pyspark.sql import DataFrameWriter

from tests.compare import DATA
from tillsight.plans import pipeline
from tillsight.session import stage
from tillsight.sources.fixtures import AS_OF, Fixture
from tillsight.sources.tables import load_table


def test_reports_share_one_scan_and_equal_those_planned_alone(spark, tmp_path, monkeypatch):
    tables = Fixture(spark, str(DATA / "sf0.001"))
    fact = stage(tables.fact, "fact_for_reports")
    source = fact.inputFiles()[0].rsplit("/", 2)[1]
    names = {
        "sales_overview", "weekday_sales", "segment_summary", "category_performance", "top_colors", "store_summary", "country_category_mix",
        "unknown_store_split", "discount_status_summary", "top_campaign_categories", "campaign_matrix", "customers_by_place", "revenue_by_age_group",
    }
    scans, write = [], DataFrameWriter.parquet

    def watched(writer, *arguments, **options):
        text = writer._df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scans.append(sum(source in line for line in text.splitlines() if "FileScan" in line))
        return write(writer, *arguments, **options)

    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    try:
        done = pipeline.write_reports(fact, tables.dimensions, AS_OF, str(tmp_path), names)
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
        monkeypatch.undo()
    assert set(done) == names and sum(scans) == 1
    alone = pipeline.reports(fact, tables.dimensions, AS_OF)
    for name in names:
        one, shared = alone[name](), load_table(spark, name, str(tmp_path))
        assert one.dtypes == shared.dtypes and sorted(map(repr, one.collect())) == sorted(map(repr, shared.collect())), name
