"""End-to-end runs: raw transactions to final tables, and final tables to reports."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.operators import clean, customer, discount, features, kpi, product, profile, sales, store
from tillsight.session import configure, stage, stage_path, staging_scope
from tillsight.sources.tables import (
    Dimensions, as_master, as_raw_transactions, load_dimensions, load_table, save_table, with_source_rowid,
)

DIMENSIONS = ("employees", "customers", "products", "stores")


def clean_tables(raw: DataFrame, dims: Dimensions, location: str | None = None, drop_duplicates: bool = False) -> DataFrame:
    """Clean ``raw`` and write the final fact and dimensions; returns the cleaning summary.

    The fact is partitioned by year and month, so reports over a period (``in_period``) read only their
    partitions; rows are gathered by month before the write, large months in several tasks.
    Staging tables are removed once the final tables exist.
    """
    spark = raw.sparkSession
    with staging_scope(spark):
        if drop_duplicates:
            raw = stage(clean.drop_exact_duplicates(raw), "unique_lines")
        lines, before = clean.stored_lines(raw)
        final = clean.final_transactions(clean.impute(raw, dims, lines).imputed)
        day = F.col("transaction_date")
        dated = final.withColumns({"year": F.year(day), "month": F.month(day)}).hint("rebalance", "year", "month")
        counted, seen = clean.observed_final(dated)
        save_table(counted, "transactions_final", location, ("year", "month"))
        conformed = clean.final_dimensions(dims)
        for name in DIMENSIONS:
            save_table(getattr(conformed, name), f"{name}_final", location)
        written = load_table(spark, "transactions_final", location).drop("year", "month")
        result = clean.Cleaned(written, before, clean.Figures(seen, written))
        save_table(clean.cleaning_summary(result, dims), "cleaning_summary", location)
        save_table(clean.before_after(result), "before_after", location)
    return load_table(spark, "cleaning_summary", location)


def ingest(
    spark: SparkSession, source: DataFrame, discounts: DataFrame | None, location: str, masters: dict[str, DataFrame] | None = None
) -> None:
    """Write ``transactions`` (text columns and ``source_rowid``), ``discounts`` (with ``campaign_seq``) and typed masters under ``location``.

    Ids follow the stored files and their rows, so they are stable for every later read.
    """
    with staging_scope(spark):
        landed = stage_path(spark, "ingest")
        as_raw_transactions(source).write.parquet(f"{landed}/transactions")
        save_table(with_source_rowid(spark, f"{landed}/transactions"), "transactions", location)
        if discounts is not None:
            # A few rows whose order matters: one file keeps it.
            discounts.drop("campaign_seq").coalesce(1).write.parquet(f"{landed}/discounts")
            numbered = with_source_rowid(spark, f"{landed}/discounts").withColumnRenamed("source_rowid", "campaign_seq")
            save_table(numbered, "discounts", location)
        for name, master in (masters or {}).items():
            save_table(as_master(master), name, location)


def in_period(fact: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Lines from one day to another (ISO, inclusive), pruning the year and month partitions."""
    for day, later in ((start, True), (end, False)):
        if day is None:
            continue
        year, month = (int(part) for part in day.split("-")[:2])
        whole, part = (F.col("year") > year, F.col("month") >= month) if later else (F.col("year") < year, F.col("month") <= month)
        edge = F.lit(day).cast("date")
        inside = F.col("transaction_date") >= edge if later else F.col("transaction_date") <= edge
        fact = fact.filter(whole | ((F.col("year") == year) & part)).filter(inside)
    return fact


def audit_tables(raw: DataFrame, dims: Dimensions, location: str | None = None) -> None:
    """Write rejected rows and orphan keys of the raw table for review."""
    save_table(clean.rejected_rows(raw), "transactions_rejected", location)
    save_table(clean.orphan_keys(clean.clean_rows(raw), dims), "invalid_foreign_keys", location)


PROFILE_REPORTS: dict[str, Callable[[profile.Source], DataFrame]] = {
    f.__name__: f
    for f in (
        profile.row_count, profile.date_coverage, profile.monthly_rows, profile.column_report, profile.dictionary_report,
        profile.distinct_identifiers, profile.completeness, profile.placeholder_values, profile.line_total_accuracy,
        profile.invoice_total_accuracy, profile.date_parseability, profile.yearly_rows, profile.invoice_consistency,
        profile.duplicate_line_numbers, profile.recoverable_products, profile.invalid_domain_values, profile.invalid_numbers,
    )
} | {
    "transaction_types": lambda raw: profile.value_distribution(raw, "transaction_type"),
    "payment_methods": lambda raw: profile.value_distribution(raw, "payment_method"),
}


def profile_tables(raw: DataFrame, location: str | None = None) -> None:
    """Write every profile report, all from one preparation."""
    with staging_scope(raw.sparkSession):
        figures = profile.prepared(raw)
        for name, report in PROFILE_REPORTS.items():
            save_table(report(figures), name, location)


@dataclass(frozen=True)
class Lines:
    """Line items, and the same with product, store and campaign context."""

    plain: DataFrame
    goods: DataFrame
    shops: DataFrame
    placed: DataFrame
    offers: DataFrame | None

    @classmethod
    def planned(cls, fact: DataFrame, dims: Dimensions) -> Lines:
        plain = features.line_items(fact)
        goods = features.product_lines(plain, dims.products)
        offers = None if dims.discounts is None else features.discount_status(features.with_campaigns(goods, dims.discounts))
        return cls(plain, goods, features.with_stores(goods, dims.stores), features.with_stores(plain, dims.stores), offers)

    @classmethod
    def stored(cls, fact: DataFrame, dims: Dimensions) -> Lines:
        """All context joined once into a staging table, of which each report reads its columns.

        Joins and features are paid for once, not by each of some seventy reports.
        """
        plain = features.line_items(fact)
        goods = features.product_lines(plain, dims.products)
        shops = features.with_stores(goods, dims.stores)
        offers = shops if dims.discounts is None else features.discount_status(features.with_campaigns(shops, dims.discounts))
        table = stage(offers, "prepared_lines")
        added = [c for c in shops.columns if c not in goods.columns]
        context = [c for c in offers.columns if c not in shops.columns]
        return cls(
            table.select(*plain.columns), table.select(*goods.columns), table.select(*shops.columns), table.select(*plain.columns, *added),
            None if dims.discounts is None else table.select(*goods.columns, *context),
        )


def reports(fact: DataFrame, dims: Dimensions, as_of: str, prepared: Lines | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Every business report by name, as a function that plans it."""
    prepared = prepared or Lines.planned(fact, dims)
    lines, goods, shops = prepared.plain, prepared.goods, prepared.shops
    named = {
        lines: (
            sales.sales_overview, sales.monthly_revenue, sales.quarterly_revenue, sales.revenue_driver_correlation,
            sales.order_statistics, sales.order_revenue_histogram, sales.basket_analysis, sales.weekday_sales,
            sales.weekend_sales, sales.price_segment_sales, sales.return_analysis, sales.sales_insights,
            customer.customer_overview, customer.segment_summary, customer.new_vs_returning, customer.rfm_segment_summary,
            customer.top_rfm_customers, customer.cohort_retention, customer.clv_tier_summary, customer.clv_overview,
            customer.top_clv_customers, customer.rfm, customer.clv_tiers, customer.cohort_matrix, kpi.new_customers_by_month, kpi.repeat_rate, kpi.demand_by_hour, kpi.discount_share,
        ),
        goods: (
            product.product_ranking, product.product_overview, product.top_products_by_revenue, product.top_products_by_profit,
            product.bottom_products_by_profit, product.category_performance, product.top_sub_categories,
            product.top_returned_products, product.discount_by_category, product.top_colors, product.size_performance,
            product.abc_summary, product.abc_classes, product.unknown_product_split, product.monthly_top_categories, kpi.profitable_products,
        ),
        shops: (
            store.store_summary, store.store_overview, store.top_stores, store.bottom_stores, store.top_stores_per_employee,
            store.country_performance, store.top_store_cities, store.highest_return_rates, store.highest_discounts,
            store.top_category_by_store, store.country_category_mix, store.monthly_top_stores,
            store.productivity_by_employee_band, kpi.store_matrix,
        ),
        prepared.placed: (store.unknown_store_split,),
    }
    if prepared.offers is not None:
        named[prepared.offers] = (
            discount.discount_overview, discount.discount_status_summary, discount.discount_group_summary,
            discount.campaign_summary, discount.category_by_status, discount.top_campaign_categories,
            discount.monthly_status_trend, discount.discount_correlation, discount.high_discount_low_margin,
            kpi.campaign_matrix, kpi.campaign_roi, kpi.campaign_payback,
        )
    planned = {f.__name__: (lambda f=f, rows=rows: f(rows)) for rows, group in named.items() for f in group}
    for f in (customer.top_customer_cities, kpi.customers_by_place):
        planned[f.__name__] = lambda f=f: f(lines, dims.customers)
    planned["revenue_by_age_group"] = lambda: customer.revenue_by_age_group(lines, dims.customers, as_of)
    return planned


def write_reports(fact: DataFrame, dims: Dimensions, as_of: str, location: str, only: set[str] | None = None) -> list[str]:
    """Write each report as a table under ``location``; returns their names. The fact table is scanned once for all of them."""
    done = []
    with staging_scope(fact.sparkSession):  # for what several reports read
        for name, plan in reports(fact, dims, as_of, Lines.stored(fact, dims)).items():
            if only is None or name in only:
                with staging_scope(fact.sparkSession):
                    save_table(plan(), name, location)
                done.append(name)
    return done


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Profile, clean and analyse retail transactions.")
    parser.add_argument("step", choices=("ingest", "profile", "clean", "report"))
    parser.add_argument("--tables", required=True, help="folder of parquet tables (raw and masters, or final tables)")
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--format", default="parquet", help="format of the tables to ingest (csv files have a header)")
    parser.add_argument("--from", dest="start", help="first day of the reports")
    parser.add_argument("--to", dest="end", help="last day of the reports")
    parser.add_argument("--as-of", default="2025-01-01", help="day on which customer ages are taken")
    parser.add_argument("--drop-duplicates", action="store_true", help="remove exact copies of raw lines first")
    options = parser.parse_args(arguments)
    spark = configure(SparkSession.builder.appName("tillsight").getOrCreate())
    if options.step == "ingest":
        read = spark.read.option("header", "true").option("escape", "\"").format(options.format)
        offers = read.load(f"{options.tables}/discounts")
        masters = {name: read.load(f"{options.tables}/{name}") for name in DIMENSIONS}
        ingest(spark, read.load(f"{options.tables}/transactions"), offers, options.out, masters)
        return
    if options.step == "report":
        fact = in_period(load_table(spark, "transactions_final", options.tables), options.start, options.end).drop("year", "month")
        write_reports(fact, load_dimensions(spark, options.tables, "_final"), options.as_of, options.out)
        return
    raw = load_table(spark, "transactions", options.tables)
    if options.step == "profile":
        profile_tables(raw, options.out)
        return
    dims = load_dimensions(spark, options.tables)
    audit_tables(raw, dims, options.out)
    clean_tables(raw, dims, options.out, options.drop_duplicates).show(truncate=False)


if __name__ == "__main__":
    main()
