"""Profile reports from one preparation, and mergeable estimates."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.compare import DATA
from tillsight.operators import profile
from tillsight.plans import pipeline
from tillsight.session import stage
from tillsight.sources.fixtures import Fixture


@pytest.fixture(scope="module")
def raw(spark):
    return stage(Fixture(spark, str(DATA / "sf0.001")).raw, "raw_for_profile")


def test_reports_from_one_preparation_equal_those_of_the_table(spark, raw):
    figures = profile.prepared(raw)
    for name, report in pipeline.PROFILE_REPORTS.items():
        direct, shared = report(raw), report(figures)
        assert direct.dtypes == shared.dtypes, name
        assert direct.collect() == shared.collect(), name
    empty, table = profile.prepared(raw.limit(0)), raw.limit(0)
    for name, report in pipeline.PROFILE_REPORTS.items():
        assert report(table).collect() == report(empty).collect(), name


def test_the_profile_step_scans_the_table_four_times(spark, raw, tmp_path, monkeypatch):
    scans, write = [], DataFrameWriter.parquet
    source = raw.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]

    def watched(writer, *arguments, **options):
        plan = writer._df._jdf.queryExecution().executedPlan()
        text = plan.toString()
        scans.append(sum(source in line for line in text.split("== Initial Plan ==")[0].splitlines() if "FileScan" in line))
        return write(writer, *arguments, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    conf = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "5000")
    try:
        pipeline.profile_tables(raw, str(tmp_path))
    finally:
        spark.conf.set(conf, before)
    assert sum(scans) == 4 and len(scans) == 4 + len(pipeline.PROFILE_REPORTS)


def test_estimates_of_distinct_identifiers_merge(spark, raw):
    exact = profile.distinct_identifiers(raw).first().asDict()
    whole = profile.identifier_sketches(raw)
    months = stage(whole.where("month is not null"), "sketches")
    rest = profile.identifier_sketches(raw.where(profile.to_day(F.col("date")).isNull()))
    merged = profile.estimated_identifiers(months.unionByName(rest)).first().asDict()
    at_once = profile.estimated_identifiers(whole).first().asDict()
    assert merged["total_rows"] == at_once["total_rows"] == exact["total_rows"]
    for name, value in exact.items():
        assert merged[name] == pytest.approx(at_once[name], rel=0.01), name  # the order of merging shows in the last digits
        assert merged[name] == pytest.approx(value, rel=0.06), name  # four times the stated error
    assert set(profile.estimated_identifiers(whole.limit(0)).first()) == {0}
