"""Named queries over one folder of driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.operators import clean, customer, discount, features, kpi, product, profile, sales, store
from tillsight.schema import FINAL_COLUMNS
from tillsight.session import stage
from tillsight.sources.fixtures import AS_OF, MONTHS, Fixture
from tillsight.sources.tables import with_source_rowid

Query = Callable[[SparkSession, str], DataFrame]


def _lines(t: Fixture) -> DataFrame:
    return features.line_items(t.fact)


def _product_lines(t: Fixture) -> DataFrame:
    return features.product_lines(_lines(t), t.products)


def _store_lines(t: Fixture) -> DataFrame:
    return features.store_lines(_lines(t), t.products, t.stores)


def _discount_lines(t: Fixture) -> DataFrame:
    return features.discount_lines(_lines(t), t.products, t.discounts)


def _untyped_fact(t: Fixture) -> DataFrame:
    columns = ("unit_price", "quantity", "discount", "line_total")
    return t.raw.select("source_rowid", "invoice_id", F.col("date").alias("transaction_date"), *columns)


def _invoices(t: Fixture) -> DataFrame:
    return features.invoice_summary(_lines(t))


def _staged_invoice_revenue(t: Fixture) -> DataFrame:
    return stage(_invoices(t).select("invoice_id", "order_revenue"), "invoice_revenue")


SOURCES = {
    "s01_load_fact": lambda t: t.fact.select(*FINAL_COLUMNS),
    "s08_row_ids": lambda t: with_source_rowid(t.spark, f"{t.folder}/orders.parquet").select(
        "source_rowid", "o_orderkey", "o_custkey", "o_orderdate"
    ),
}

FEATURES = {
    "f01_coerce_types": lambda t: features.coerce_types(_untyped_fact(t)),
    "f02_drop_unusable": lambda t: features.drop_unusable(features.coerce_types(_untyped_fact(t))),
    "f03_sales_measures": lambda t: _lines(t).select("source_rowid", "gross_sales", "discount_amount"),
    "f04_signed_revenue": lambda t: _lines(t).select("source_rowid", "transaction_type", "revenue"),
    "f05_time_features": lambda t: _lines(t).select("source_rowid", "year", "month", "quarter", "day", "weekday", "is_weekend"),
    "f06_is_return": lambda t: _lines(t).select("source_rowid", "is_return"),
    "f07_price_segment": lambda t: features.price_segments(_lines(t)).select("source_rowid", "unit_price", "price_segment"),
    "f08_discount_group": lambda t: _lines(t).select("source_rowid", "discount", "discount_group"),
    "f09_invoice_summary": _invoices,
    "f10_item_value": lambda t: features.item_value(_invoices(t)).select("invoice_id", "avg_item_per_order"),
    "f11_basket_group": lambda t: features.basket_groups(_invoices(t)).select("invoice_id", "order_quantity", "basket_size_group"),
    "f12_order_value_group": lambda t: features.order_value_groups(_staged_invoice_revenue(t)),
    "f13_weekday_order": lambda t: _lines(t).select("source_rowid", "weekday", "weekday_ord"),
}

SALES = {
    "a01_sales_overview": sales.sales_overview,
    "a02_monthly_revenue": sales.monthly_revenue,
    "a03_quarterly_revenue": sales.quarterly_revenue,
    "a04_revenue_driver_correlation": sales.revenue_driver_correlation,
    "a05_order_statistics": sales.order_statistics,
    "a06_order_revenue_histogram": sales.order_revenue_histogram,
    "a07_basket_analysis": sales.basket_analysis,
    "a08_weekday_sales": sales.weekday_sales,
    "a09_weekend_sales": sales.weekend_sales,
    "a10_price_segment_sales": sales.price_segment_sales,
    "a11_return_analysis": sales.return_analysis,
    "a12_sales_insights": sales.sales_insights,
}

RFM_SCORES = ("customer_id", "recency", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score", "rfm_code")
CUSTOMERS = {
    "u01_with_customers": lambda t: features.with_customers(_lines(t), t.customers).select(
        "source_rowid", "customer_id", "name", "city", "country", "job_title"
    ),
    "u02_customer_summary": lambda t: features.customer_summary(_lines(t)),
    "u03_customer_segment": lambda t: customer.customer_segments(_lines(t)).select("customer_id", "customer_revenue", "customer_segment"),
    "u04_customer_type": lambda t: features.customer_type(_lines(t)).select("source_rowid", "customer_id", "first_purchase", "customer_type"),
    "u05_demographics": lambda t: features.demographics(features.with_customers(_lines(t), t.customers), AS_OF).select(
        "source_rowid", "gender", "city", "age", "age_group"
    ),
    "u06_customer_overview": lambda t: customer.customer_overview(_lines(t)),
    "u07_segment_summary": lambda t: customer.segment_summary(_lines(t)),
    "u08_new_vs_returning": lambda t: customer.new_vs_returning(_lines(t)),
    "u09_revenue_by_age_group": lambda t: customer.revenue_by_age_group(_lines(t), t.customers, AS_OF),
    "u10_top_customer_cities": lambda t: customer.top_customer_cities(_lines(t), t.customers),
    "u11_rfm_scores": lambda t: customer.rfm(_lines(t)).select(*RFM_SCORES),
    "u12_rfm_segment": lambda t: customer.rfm(_lines(t)).select("customer_id", "rfm_code", "rfm_segment"),
    "u13_rfm_segment_summary": lambda t: customer.rfm_segment_summary(_lines(t)),
    "u14_top_rfm_customers": lambda t: customer.top_rfm_customers(_lines(t)),
    "u15_cohort_index": lambda t: customer.cohort_index(_lines(t)).select(
        "source_rowid", "customer_id", "order_month", "cohort_month", "cohort_index"
    ),
    "u16_cohort_retention": lambda t: customer.cohort_retention(_lines(t)),
    "u16_cohort_matrix": lambda t: customer.cohort_matrix(_lines(t), months=MONTHS),
    "u17_customer_value": lambda t: customer.customer_value(_lines(t)).select(
        "customer_id", "customer_revenue", "customer_lifespan_days", "observed_customer_days", "annualized_clv"
    ),
    "u18_clv_tiers": lambda t: customer.clv_tiers(_lines(t)).select("customer_id", "historical_clv", "clv_tier"),
    "u18_clv_tier_summary": lambda t: customer.clv_tier_summary(_lines(t)),
    "u19_clv_overview": lambda t: customer.clv_overview(_lines(t)),
    "u20_top_clv_customers": lambda t: customer.top_clv_customers(_lines(t)),
    "r01_new_customers": lambda t: kpi.new_customers_by_month(_lines(t)),
    "r02_repeat_rate": lambda t: kpi.repeat_rate(_lines(t)),
    "r03_customers_by_place": lambda t: kpi.customers_by_place(_lines(t), t.customers),
    "r06_demand_by_hour": lambda t: kpi.demand_by_hour(_lines(t)),
    "r08_discount_share": lambda t: kpi.discount_share(_lines(t)),
}

PRODUCTS = {
    "p01_product_lines": lambda lines: lines.select(
        "source_rowid", "product_id", "category", "sub_category", "product_name", "product_master_color",
        "available_sizes", "production_cost",
    ),
    "p02_profit_measures": lambda lines: lines.select(
        "source_rowid", "signed_quantity", "units_sold", "units_returned", "cost_impact", "gross_profit", "profit_margin"
    ),
    "p03_unknown_product_split": product.unknown_product_split,
    "p04_product_summary": product.product_ranking,
    "p05_product_overview": product.product_overview,
    "p06_top_products_by_revenue": product.top_products_by_revenue,
    "p07_top_products_by_profit": product.top_products_by_profit,
    "p08_bottom_products_by_profit": product.bottom_products_by_profit,
    "p09_category_performance": product.category_performance,
    "p10_top_sub_categories": product.top_sub_categories,
    "p11_top_returned_products": product.top_returned_products,
    "p12_discount_by_category": product.discount_by_category,
    "p13_top_colors": product.top_colors,
    "p14_size_performance": product.size_performance,
    "p15_abc_classes": product.abc_classes,
    "p16_abc_summary": product.abc_summary,
    "p17_monthly_top_categories": product.monthly_top_categories,
    "r04_profitable_products": kpi.profitable_products,
    "r05_revenue_contribution": kpi.revenue_contribution,
}

PLACES = {
    "t01_store_lines": lambda t: features.with_stores(_lines(t), t.stores).select(
        "source_rowid", "store_id", "store_name", "country", "city", "zip_code", "number_of_employees"
    ),
    "t02_unknown_store_split": lambda t: store.unknown_store_split(features.with_stores(_lines(t), t.stores)),
}

STORES = {
    "t03_store_summary": store.store_summary,
    "t04_store_overview": store.store_overview,
    "t05_top_stores": store.top_stores,
    "t06_bottom_stores": store.bottom_stores,
    "t07_top_stores_per_employee": store.top_stores_per_employee,
    "t08_country_performance": store.country_performance,
    "t09_top_store_cities": store.top_store_cities,
    "t10_highest_return_rates": store.highest_return_rates,
    "t11_highest_discounts": store.highest_discounts,
    "t12_top_category_by_store": store.top_category_by_store,
    "t13_country_category_mix": store.country_category_mix,
    "t14_monthly_top_stores": store.monthly_top_stores,
    "t15_productivity_by_employee_band": store.productivity_by_employee_band,
    "r07_store_matrix": kpi.store_matrix,
}

DISCOUNTS = {
    "k02_campaign_assignment": lambda lines: lines.select(
        "source_rowid", "campaign_description", "campaign_discount", "is_campaign_period"
    ),
    "k03_discount_status": lambda lines: lines.select("source_rowid", "has_discount", "discount_gap", "discount_status"),
    "k04_discount_overview": discount.discount_overview,
    "k05_discount_status_summary": discount.discount_status_summary,
    "k06_discount_group_summary": discount.discount_group_summary,
    "k07_campaign_summary": discount.campaign_summary,
    "k08_category_by_status": discount.category_by_status,
    "k09_top_campaign_categories": discount.top_campaign_categories,
    "k10_monthly_status_trend": discount.monthly_status_trend,
    "k11_discount_correlation": discount.discount_correlation,
    "k12_high_discount_low_margin": discount.high_discount_low_margin,
    "r09_campaign_matrix": kpi.campaign_matrix,
    "r10_campaign_roi": kpi.campaign_roi,
    "r11_campaign_payback": kpi.campaign_payback,
}


PROFILE = {
    "d01_row_count": profile.row_count,
    "d02_date_coverage": profile.date_coverage,
    "d03_monthly_rows": profile.monthly_rows,
    "d04_transaction_types": lambda raw: profile.value_distribution(raw, "transaction_type"),
    "d05_payment_methods": lambda raw: profile.value_distribution(raw, "payment_method"),
    "d06_column_report": profile.column_report,
    "d07_dictionary_report": profile.dictionary_report,
    "d08_distinct_identifiers": profile.distinct_identifiers,
    "d09_completeness": profile.completeness,
    "d10_placeholder_values": profile.placeholder_values,
    "d11_line_total_accuracy": profile.line_total_accuracy,
    "d12_invoice_total_accuracy": profile.invoice_total_accuracy,
    "d13_date_parseability": profile.date_parseability,
    "d14_yearly_rows": profile.yearly_rows,
    "d15_invoice_consistency": profile.invoice_consistency,
    "d16_duplicate_line_numbers": profile.duplicate_line_numbers,
    "d17_recoverable_products": profile.recoverable_products,
    "d18_invalid_domain_values": profile.invalid_domain_values,
    "d19_invalid_numbers": profile.invalid_numbers,
    "c01_normalise": lambda raw: clean.normalised_view(raw).drop("has_critical_issue"),
    "c02_critical_flag": lambda raw: clean.normalised_view(raw).select("source_rowid", "has_critical_issue"),
    "c03_clean_rows": clean.clean_rows,
    "c04_rejected_rows": clean.rejected_rows,
    "c06_invoice_consensus": lambda raw: clean.invoice_consensus(clean.normalise(raw)),
    "c07_price_modes": lambda raw: clean.price_modes(clean.sale_histogram(clean.normalise(raw))),
    "c08_quantity_modes": lambda raw: clean.quantity_modes(clean.sale_histogram(clean.normalise(raw))),
    "c09_common_quantity": lambda raw: clean.common_quantity(clean.sale_histogram(clean.normalise(raw))),
    "c11_return_customers": lambda raw: clean.return_customers(clean.normalise(raw)),
    "c12_line_numbers": lambda raw: clean.line_numbers(clean.normalise(raw)),
}


def _imputed(t: Fixture) -> clean.Imputation:
    return clean.impute(t.raw, t.dimensions)


def _final(t: Fixture) -> DataFrame:
    return clean.final_transactions(_imputed(t).imputed)


FILLED_COLUMNS = (
    "source_rowid", "invoice_id", "line_no", "customer_id", "product_id", "size", "color", "unit_price", "quantity",
    "transaction_datetime", "discount", "line_total", "store_id", "employee_id", "currency", "currency_symbol", "sku",
    "transaction_type", "payment_method", "invoice_total",
)
SETTLED_COLUMNS = ("source_rowid", "size", "color", "unit_price", "quantity", "transaction_date", "discount")
CLEANING = {
    "c05_orphan_keys": lambda t: clean.orphan_keys(clean.clean_rows(t.raw), t.dimensions),
    "c05_orphan_keys_final": lambda t: clean.orphan_keys(_final(t), clean.final_dimensions(t.dimensions)),
    "c10_sku_products": lambda t: clean.sku_products(clean.normalise(t.raw), t.products),
    "c13_filled": lambda t: _imputed(t).filled.select(*FILLED_COLUMNS),
    "c14_derived_amounts": lambda t: _imputed(t).derived.select("source_rowid", *clean.FORMULAS),
    "c15_settled_values": lambda t: _imputed(t).settled.select(*SETTLED_COLUMNS),
    "c16_line_totals": lambda t: _imputed(t).settled.select("source_rowid", "line_total"),
    "c17_residuals": lambda t: _imputed(t).residual.select("source_rowid", "invoice_id", "line_total_from_invoice_residual"),
    "c18_imputed": lambda t: _imputed(t).imputed,
    "c19_without_duplicates": lambda t: clean.drop_exact_duplicates(t.raw_doubled),
    "c20_final_employees": lambda t: clean.final_employees(t.employees, t.stores),
    "c21_final_customers": lambda t: clean.final_customers(t.customers),
    "c22_final_products": lambda t: clean.final_products(t.products),
    "c23_final_stores": lambda t: clean.final_stores(t.stores),
    "c24_final_transactions": _final,
    "c25_cleaning_summary": lambda t: clean.cleaning_summary(clean.cleaned(t.raw, t.dimensions), t.dimensions),
    "c26_before_after": lambda t: clean.before_after(clean.cleaned(t.raw, t.dimensions)),
}


def _raw(t: Fixture) -> DataFrame:
    return t.raw


def _bound(operator: Callable[..., DataFrame], source: Callable[[Fixture], DataFrame] | None = None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables = Fixture(spark, folder)
        return operator(tables if source is None else source(tables))

    return run


def queries() -> dict[str, Query]:
    groups = (
        (SOURCES, None), (PROFILE, _raw), (CLEANING, None), (FEATURES, None), (SALES, _lines), (CUSTOMERS, None), (PRODUCTS, _product_lines), (PLACES, None),
        (STORES, _store_lines), (DISCOUNTS, _discount_lines),
        ({"k01_campaigns": lambda t: features.campaigns(t.discounts)}, None),
    )
    return {name: _bound(op, source) for group, source in groups for name, op in group.items()}
