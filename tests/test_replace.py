"""A table is replaced as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from tillsight.sources.tables import PREVIOUS, load_table, save_table


def failing(spark):
    """Rows whose last one stops the job after others have been written."""
    return spark.range(0, 4000, 1, 8).select(F.when(F.col("id") == 3999, F.raise_error("stop")).otherwise(F.col("id")).cast("long").alias("id"))


@pytest.mark.parametrize("partitioned", [(), ("part",)])
def test_a_failing_job_leaves_the_former_files(spark, tmp_path, partitioned):
    table = lambda df: df.withColumn("part", F.col("id") % 3)
    save_table(table(spark.range(10)), "t", f"file://{tmp_path}", partitioned)
    with pytest.raises(Exception, match="stop"):
        save_table(table(failing(spark)), "t", f"file://{tmp_path}", partitioned)
    assert load_table(spark, "t", f"file://{tmp_path}").count() == 10
    assert os.listdir(tmp_path) == ["t"]
    save_table(table(spark.range(5)), "t", f"file://{tmp_path}", partitioned)
    assert load_table(spark, "t", str(tmp_path)).count() == 5 and os.listdir(tmp_path) == ["t"]


def test_a_table_may_be_made_from_itself(spark, tmp_path):
    save_table(spark.range(10), "t", str(tmp_path))
    save_table(load_table(spark, "t", str(tmp_path)).where("id > 6"), "t", str(tmp_path))
    assert sorted(r.id for r in load_table(spark, "t", str(tmp_path)).collect()) == [7, 8, 9]


def test_a_switch_that_was_cut_off_is_read_and_mended(spark, tmp_path):
    save_table(spark.range(10), "t", str(tmp_path))
    os.rename(tmp_path / "t", tmp_path / f"t{PREVIOUS}")
    assert load_table(spark, "t", str(tmp_path)).count() == 10
    save_table(spark.range(3), "t", str(tmp_path))
    assert load_table(spark, "t", str(tmp_path)).count() == 3 and os.listdir(tmp_path) == ["t"]


def test_catalog_tables(spark):
    save_table(spark.range(10), "replaced")
    with pytest.raises(Exception, match="stop"):
        save_table(failing(spark), "replaced")
    assert load_table(spark, "replaced").count() == 10
    save_table(spark.range(3), "replaced")
    assert load_table(spark, "replaced").count() == 3
    spark.sql("ALTER TABLE replaced RENAME TO replaced_previous")
    assert load_table(spark, "replaced").count() == 3
    save_table(spark.range(2), "replaced")
    assert load_table(spark, "replaced").count() == 2
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("replaced")] == ["replaced"]
    spark.sql("DROP TABLE replaced")
