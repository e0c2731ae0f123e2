"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from tillsight.plans.catalog import queries
from tillsight.sources.fixtures import Fixture

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = (
    "a01_sales_overview", "a02_monthly_revenue", "a04_revenue_driver_correlation", "a07_basket_analysis",
    "a10_price_segment_sales", "u02_customer_summary", "u08_new_vs_returning", "u13_rfm_segment_summary",
    "u16_cohort_retention", "u18_clv_tier_summary", "p04_product_summary", "p09_category_performance", "p16_abc_summary",
    "t03_store_summary", "t12_top_category_by_store", "k05_discount_status_summary", "k09_top_campaign_categories",
    "d08_distinct_identifiers", "d09_completeness", "d12_invoice_total_accuracy", "d15_invoice_consistency",
    "c24_final_transactions", "c25_cleaning_summary", "c26_before_after",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tillsight-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tillsight-bench-')}")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = queries(), {}
    start = time.perf_counter()
    tables = Fixture(spark, FOLDER)
    for table in (tables.fact, tables.raw):  # landing the bound tables is reported on its own
        table.write.format("noop").mode("overwrite").save()
    landing = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            known[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "landing": landing, "sf": os.path.basename(FOLDER.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
