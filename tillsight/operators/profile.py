"""Data-quality profile of the raw transaction table.

Every report is a function of the raw table. ``prepared`` takes what all of them need in four passes over the table, and the
same functions then read from it: one aggregation holds all row-level figures, one grouping counts all listed values, one
collects figures per invoice, and one reduces keys to distinct ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.semantics import (
    blank_label, exact_sum, is_dirty, money, percent, tally, to_day, to_real,
)
from tillsight.session import stage
from tillsight.sources.tables import column_listing

IDENTIFIERS = ("invoice_id", "customer_id", "product_id", "sku", "store_id", "employee_id")
CONSISTENCY = {
    "customer_id": "invoices_with_multiple_customers",
    "store_id": "invoices_with_multiple_stores",
    "employee_id": "invoices_with_multiple_employees",
    "date": "invoices_with_multiple_datetimes",
    "payment_method": "invoices_with_multiple_payment_methods",
    "invoice_total": "invoices_with_multiple_invoice_totals",
}


def _dirty(column: str) -> Column:
    return is_dirty(s.RAW[column])


def _real(column: str) -> Column:
    """Numeric value of a raw column as double, NULL when dirty."""
    return F.when(~_dirty(column), to_real(F.col(column)))


@dataclass(frozen=True)
class Prepared:
    """Stored figures of a raw table, to be given to the reports in its place."""

    columns: list[tuple[str, str]]
    totals: DataFrame  # one row with a struct for each report
    values: DataFrame  # report, first, second, row_count
    invoices: DataFrame  # one row with a struct for each report
    keys: DataFrame  # field, first, second, row_count

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return self.columns


Source = DataFrame | Prepared


# ---- figures of rows --------------------------------------------------------

def _coverage(raw: Source) -> list[Column]:
    day = to_day(F.col("date"))
    return [
        F.min(day).alias("min_transaction_date"), F.max(day).alias("max_transaction_date"), F.count("*").alias("total_rows"),
        tally(_dirty("date")).alias("missing_or_dirty_date_rows"),
    ]


def _line_accuracy(raw: Source) -> list[Column]:
    price, quantity, rate, amount = (_real(c) for c in ("unit_price", "quantity", "discount", "line_total"))
    missing = price.isNull() | quantity.isNull() | rate.isNull() | amount.isNull()
    off = F.abs(F.abs(amount) - money(price * quantity * (1 - rate))) > s.AMOUNT_TOLERANCE
    return [
        F.count("*").alias("total_rows"), tally(missing).alias("rows_not_checkable_due_to_missing_values"),
        tally(~missing & off).alias("possible_inaccurate_line_total_rows"),
    ]


def _parseability(raw: Source) -> list[Column]:
    day, dirty = to_day(F.col("date")), _dirty("date")
    return [
        F.count("*").alias("total_rows"), F.min(day).alias("min_parseable_date"), F.max(day).alias("max_parseable_date"),
        tally(dirty).alias("missing_or_dirty_date_rows"), tally(~dirty & day.isNull()).alias("unparsable_date_rows"),
    ]


def _recoverable(raw: Source) -> list[Column]:
    missing = _dirty("product_id")
    return [
        F.count("*").alias("total_rows"), tally(missing).alias("missing_product_id_rows"),
        tally(missing & ~_dirty("sku")).alias("missing_product_id_but_sku_available_rows"),
    ]


def _listed_number(column: str) -> Column:
    raw = F.col(column)
    return raw.isNotNull() & ~F.trim(raw).isin(*s.NUMBER_PLACEHOLDERS)


def _number_faults(raw: Source) -> list[Column]:
    price, quantity = to_real(F.col("unit_price")), to_real(F.col("quantity"))
    rate, invoice_total = to_real(F.col("discount")), to_real(F.col("invoice_total"))
    return [
        tally(_listed_number("unit_price") & (price < 0)).alias("negative_unit_price_rows"),
        tally(_listed_number("quantity") & (quantity <= 0)).alias("non_positive_quantity_rows"),
        tally(_listed_number("discount") & ((rate < 0) | (rate > 1))).alias("invalid_discount_rows"),
        tally(_listed_number("invoice_total") & (invoice_total == -1)).alias("invoice_total_placeholder_minus_one_rows"),
    ]


TOTALS: dict[str, Callable[[Source], list[Column]]] = {
    "row_count": lambda raw: [F.count("*").alias("total_transaction_rows")],
    "date_coverage": _coverage,
    "column_report": lambda raw: [F.count(name).alias(name) for name, _ in raw.dtypes],
    "dictionary_report": lambda raw: [F.count(c.name).alias(c.name) for c in s.RAW_COLUMNS],
    "completeness": lambda raw: [F.count("*").alias("total_rows"), *[tally(is_dirty(c)).alias(c.name) for c in s.RAW_COLUMNS]],
    "line_total_accuracy": _line_accuracy,
    "date_parseability": _parseability,
    "recoverable_products": _recoverable,
    "invalid_numbers": _number_faults,
}


def _totals(raw: Source, report: str) -> DataFrame:
    return raw.totals.select(f"{report}.*") if isinstance(raw, Prepared) else raw.agg(*TOTALS[report](raw))


def row_count(raw: Source) -> DataFrame:
    return _totals(raw, "row_count")


def date_coverage(raw: Source) -> DataFrame:
    share = percent(F.col("missing_or_dirty_date_rows"), F.col("total_rows"))
    return _totals(raw, "date_coverage").withColumn("missing_or_dirty_date_pct", share)


def column_report(raw: Source, primary_key: tuple[str, ...] = ("source_rowid",)) -> DataFrame:
    """Position, name, type and key role of each column, with how many rows have a value."""
    cells = [
        F.struct(
            F.lit(i).alias("ordinal_position"), F.lit(name).alias("column_name"), F.lit(kind).alias("declared_type"),
            F.lit(key).alias("is_primary_key"), F.col(name).alias("rows_present"),
        )
        for i, name, kind, key in column_listing(raw, primary_key)
    ]
    return _totals(raw, "column_report").select(F.inline(F.array(*cells)))


def dictionary_report(raw: Source) -> DataFrame:
    """Business meaning of each raw column, with how many rows have a value."""
    cells = [
        F.struct(
            F.lit(c.name).alias("column_name"), F.lit(c.meaning).alias("business_meaning"), F.col(c.name).alias("rows_present")
        )
        for c in s.RAW_COLUMNS
    ]
    return _totals(raw, "dictionary_report").select(F.inline(F.array(*cells)))


def completeness(raw: Source) -> DataFrame:
    """Missing or placeholder values per column, worst first; one pass over the table."""
    cells = [
        F.struct(F.lit(c.name).alias("column_name"), F.lit(c.label).alias("column_type"), F.col(c.name).alias("missing_or_dirty_rows"))
        for c in s.RAW_COLUMNS
    ]
    listed = _totals(raw, "completeness").select("total_rows", F.inline(F.array(*cells)))
    share = percent(F.col("missing_or_dirty_rows"), F.col("total_rows"))
    return listed.withColumn("missing_or_dirty_pct", share).orderBy(F.desc("missing_or_dirty_rows"), "column_name")


def line_total_accuracy(raw: Source) -> DataFrame:
    """Lines whose total strays from price, quantity and discount."""
    return _totals(raw, "line_total_accuracy")


def date_parseability(raw: Source) -> DataFrame:
    return _totals(raw, "date_parseability")


def recoverable_products(raw: Source) -> DataFrame:
    return _totals(raw, "recoverable_products")


def invalid_numbers(raw: Source) -> DataFrame:
    return _totals(raw, "invalid_numbers")


# ---- listed values ----------------------------------------------------------

def _cell(first: Column, second: Column | None = None) -> Column:
    return F.struct(first.cast("string").alias("first"), (F.lit(None) if second is None else second).cast("string").alias("second"))


def _period(pattern: str) -> list[Column]:
    return [F.when(~_dirty("date"), _cell(F.date_format(to_day(F.col("date")), pattern)))]


def _listed(checks: dict[str, Column]) -> list[Column]:
    """A cell (column, value) for each column whose check holds."""
    return [F.when(check, _cell(F.lit(c), blank_label(F.col(c)))) for c, check in checks.items()]


def _outside(column: str, allowed: tuple[str, ...]) -> Column:
    return F.col(column).isNull() | ~F.trim(column).isin(*allowed)


def _out_of_domain() -> dict[str, Column]:
    rate = to_real(F.col("discount"))
    return {
        "transaction_type": _outside("transaction_type", s.TRANSACTION_TYPES),
        "payment_method": _outside("payment_method", s.PAYMENT_METHODS),
        "currency": _outside("currency", s.CURRENCIES),
        "discount": ~_listed_number("discount") | (rate < 0) | (rate > 1),
    }


#: What each report counts: cells of two texts, NULL where a row has none.
VALUES: dict[str, Callable[[], list[Column]]] = {
    "monthly_rows": lambda: _period("yyyy-MM"),
    "yearly_rows": lambda: _period("yyyy"),
    "transaction_type": lambda: [_cell(blank_label(F.col("transaction_type")))],
    "payment_method": lambda: [_cell(blank_label(F.col("payment_method")))],
    "placeholder_values": lambda: _listed({c: _dirty(c) for c in s.PLACEHOLDER_REPORT}),
    "invalid_domain_values": lambda: _listed(_out_of_domain()),
}


def _present(cells: list[Column]) -> Column:
    return F.filter(F.array(*cells), lambda cell: cell.isNotNull())


def _values(raw: Source, report: str) -> DataFrame:
    """``first``, ``second`` and ``row_count`` of the cells of a report."""
    if isinstance(raw, Prepared):
        return raw.values.where(F.col("report") == report).drop("report")
    cells = VALUES[report]()
    one = raw.select(cells[0].alias("cell")).where(F.col("cell").isNotNull()) if len(cells) == 1 else raw.select(F.explode(_present(cells)).alias("cell"))
    return one.groupBy("cell.first", "cell.second").agg(F.count("*").alias("row_count"))


def _periods(raw: Source, report: str, name: str) -> DataFrame:
    """Rows per calendar period of non-dirty dates; unparsable dates count under NULL."""
    return _values(raw, report).select(F.col("first").alias(name), "row_count").orderBy(name)


def monthly_rows(raw: Source) -> DataFrame:
    return _periods(raw, "monthly_rows", "transaction_month")


def yearly_rows(raw: Source) -> DataFrame:
    return _periods(raw, "yearly_rows", "transaction_year")


def value_distribution(raw: Source, column: str) -> DataFrame:
    """Rows per trimmed value of a column (of those in ``VALUES``) and their share of the table."""
    counts = _values(raw, column).select(F.col("first").alias(column), "row_count")
    counts = counts if isinstance(raw, Prepared) else stage(counts, "value_counts")
    whole = counts.agg(F.sum("row_count").alias("n")).scalar()
    return counts.withColumn("row_pct", percent(F.col("row_count"), whole)).orderBy(F.desc("row_count"), column)


def _listed_values(raw: Source, report: str, name: str, value: str) -> DataFrame:
    counted = _values(raw, report).select(F.col("first").alias(name), F.col("second").alias(value), "row_count")
    return counted.orderBy(name, F.desc("row_count"), value)


def placeholder_values(raw: Source) -> DataFrame:
    return _listed_values(raw, "placeholder_values", "column_name", "dirty_value")


def invalid_domain_values(raw: Source) -> DataFrame:
    return _listed_values(raw, "invalid_domain_values", "field_name", "invalid_value")


# ---- invoices ---------------------------------------------------------------

def _total_parts() -> list[Column]:
    line_total = _real("line_total")
    return [
        F.max(_real("invoice_total")).alias("invoice_total"), money(exact_sum(line_total)).alias("sum_line_total"),
        tally(line_total.isNull()).alias("missing_lines"),
    ]


def _total_figures() -> list[Column]:
    unchecked = F.col("invoice_total").isNull() | (F.col("missing_lines") > 0)
    off = F.abs(F.col("invoice_total") - F.col("sum_line_total")) > s.AMOUNT_TOLERANCE
    return [
        F.count("*").alias("invoices_checked"), tally(unchecked).alias("invoices_not_checkable_due_to_missing_values"),
        tally(~unchecked & off).alias("possible_inaccurate_invoice_total_count"),
    ]


def _extremes() -> list[Column]:
    value = {c: _real(c) if s.RAW[c].numeric else F.when(~_dirty(c), F.col(c)) for c in CONSISTENCY}
    return [e(value[c]).alias(f"{n}_{c}") for c in CONSISTENCY for n, e in (("lo", F.min), ("hi", F.max))]


def _disagreements() -> list[Column]:
    return [F.count("*").alias("invoices_checked"), *[tally(F.col(f"lo_{c}") != F.col(f"hi_{c}")).alias(name) for c, name in CONSISTENCY.items()]]


#: What is gathered per invoice, and the figures over all invoices.
INVOICES = {"invoice_total_accuracy": (_total_parts, _total_figures), "invoice_consistency": (_extremes, _disagreements)}


def _invoices(raw: Source, report: str) -> DataFrame:
    if isinstance(raw, Prepared):
        return raw.invoices.select(f"{report}.*")
    parts, figures = INVOICES[report]
    return raw.filter(~_dirty("invoice_id")).groupBy("invoice_id").agg(*parts()).agg(*figures())


def invoice_total_accuracy(raw: Source) -> DataFrame:
    """Invoices whose total strays from the sum of their lines."""
    return _invoices(raw, "invoice_total_accuracy")


def invoice_consistency(raw: Source) -> DataFrame:
    """Invoices carrying more than one value of an attribute, seen as minimum <> maximum."""
    return _invoices(raw, "invoice_consistency")


# ---- keys -------------------------------------------------------------------

LINE = "line"


def _key_cells() -> list[Column]:
    """Identifiers, and the line numbers of invoices."""
    numbered = F.when(~_dirty("invoice_id") & F.col("line_no").isNotNull(), _cell(F.col("invoice_id"), F.col("line_no")))
    named = {**{c: F.when(F.col(c).isNotNull(), _cell(F.col(c))) for c in IDENTIFIERS}, LINE: numbered}
    return [F.when(cell.isNotNull(), F.struct(F.lit(field).alias("field"), cell["first"].alias("first"), cell["second"].alias("second"))) for field, cell in named.items()]


def _keys(raw: DataFrame) -> DataFrame:
    """Distinct identifiers and repeated line numbers with their rows."""
    stacked = raw.select(F.explode(_present(_key_cells())).alias("cell")).groupBy("cell.field", "cell.first", "cell.second")
    return stacked.agg(F.count("*").alias("row_count")).where((F.col("field") != LINE) | (F.col("row_count") > 1))


def distinct_identifiers(raw: Source) -> DataFrame:
    """Exact numbers of distinct identifiers; see ``identifier_sketches`` for estimates that can be merged."""
    if isinstance(raw, Prepared):
        counts = [F.count(F.when(F.col("field") == c, 1)).alias(f"distinct_{c}") for c in IDENTIFIERS]
        whole = raw.totals.select("row_count.total_transaction_rows").scalar()
        return raw.keys.agg(*counts).select(whole.alias("total_rows"), *[f"distinct_{c}" for c in IDENTIFIERS])
    result = raw.agg(F.count("*").alias("total_rows"))
    for c in IDENTIFIERS:  # one column each; several in one aggregation would copy every row once for each
        result = result.withColumn(f"distinct_{c}", raw.agg(F.countDistinct(c).alias("n")).scalar())
    return result


def duplicate_line_numbers(raw: Source, n: int = 50) -> DataFrame:
    """The invoice line numbers used most often, beyond once."""
    if isinstance(raw, Prepared):
        counts = raw.keys.where(F.col("field") == LINE).select(
            F.col("first").alias("invoice_id"), F.col("second").alias("line_no"), F.col("row_count").alias("duplicate_rows")
        )
    else:
        lines = raw.filter(~_dirty("invoice_id") & F.col("line_no").isNotNull())
        counts = lines.groupBy("invoice_id", "line_no").agg(F.count("*").alias("duplicate_rows"))
    return counts.filter(F.col("duplicate_rows") > 1).orderBy(F.desc("duplicate_rows"), "invoice_id", "line_no").limit(n)


#: Bits of the sketches' number of registers; the standard error of an estimate is about 1.04 / 2 ^ (bits / 2), here 1.6 %.
SKETCH_BITS = 12


def identifier_sketches(raw: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """A HyperLogLog sketch of each identifier per month (NULL: no readable date), with the rows; to be stored and added to.

    Sketches of new months, or of other tables, are merged with those stored without reading old rows.
    """
    month = F.date_format(to_day(F.col("date")), "yyyy-MM").alias("month")
    return raw.groupBy(month).agg(F.count("*").alias("rows"), *[F.hll_sketch_agg(c, F.lit(bits)).alias(c) for c in IDENTIFIERS])


def estimated_identifiers(sketches: DataFrame) -> DataFrame:
    """``distinct_identifiers`` estimated from ``identifier_sketches`` of any months and tables of one number of bits."""
    merged = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(f"distinct_{c}") for c in IDENTIFIERS]
    return sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), *merged)


def prepared(raw: DataFrame) -> Prepared:
    """The stored figures of all reports, from four passes over ``raw``."""
    totals = raw.agg(*[F.struct(*measures(raw)).alias(report) for report, measures in TOTALS.items()])
    cells = [
        F.when(cell.isNotNull(), F.struct(F.lit(report).alias("report"), cell["first"].alias("first"), cell["second"].alias("second")))
        for report, listed in VALUES.items() for cell in listed()
    ]
    values = raw.select(F.explode(_present(cells)).alias("cell")).groupBy("cell.report", "cell.first", "cell.second").agg(F.count("*").alias("row_count"))
    gathered = raw.filter(~_dirty("invoice_id")).groupBy("invoice_id").agg(*[part for parts, _ in INVOICES.values() for part in parts()])
    invoices = gathered.agg(*[F.struct(*figures()).alias(report) for report, (_, figures) in INVOICES.items()])
    return Prepared(raw.dtypes, stage(totals, "profile_totals"), stage(values, "profile_values"), stage(invoices, "profile_invoices"), stage(_keys(raw), "profile_keys"))
