"""DuckDB twins of the profiling and cleaning queries on the raw table."""

from __future__ import annotations

from oracle.analytics import RAW_PRELUDE, strict_day
from oracle.base import bigint, pct, rnd, tally, total
from oracle import rules as s

O: dict[str, str] = {}
PREFIX = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"


def real(c: str) -> str:
    return f"COALESCE(TRY_CAST(regexp_extract(trim({c}), {PREFIX}, 0) AS DOUBLE), 0.0)"


def integer(c: str) -> str:
    """64-bit prefix; digit runs beyond it give the nearest 64-bit value."""
    digits = f"regexp_extract(trim({c}), '^[+-]?[0-9]+', 0)"
    return (f"CAST(COALESCE(greatest(least(TRY_CAST({digits} AS HUGEINT), 9223372036854775807), -9223372036854775808), "
            f"CASE WHEN {digits} LIKE '-%' THEN -9223372036854775808 WHEN {digits} <> '' THEN 9223372036854775807 END, 0) AS BIGINT)")


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def dirty(name: str) -> str:
    rule = s.RAW[name]
    minus_one = f" OR {real(name)} = -1" if rule.numeric else ""
    return f"({name} IS NULL OR trim({name}) IN {listed(rule.placeholders)}{minus_one})"


def value(name: str) -> str:
    kind = s.RAW[name].kind
    got = real(name) if kind == "real" else integer(name) if kind == "int" else f"trim({name})"
    return f"CASE WHEN NOT {dirty(name)} THEN {got} END"


def number(name: str) -> str:
    return f"CASE WHEN NOT {dirty(name)} THEN {real(name)} END"


def shown(name: str) -> str:
    return f"COALESCE(NULLIF(trim({name}), ''), '[blank]')"


def add(key: str, body: str, extra: str = "") -> None:
    O[key] = RAW_PRELUDE + (f",\n{extra}" if extra else "") + "\n" + body


# ---- profile ----
DAY = strict_day("date")
add("d01_row_count", "SELECT COUNT(*) AS total_transaction_rows FROM transactions")
add("d02_date_coverage", f"""
SELECT MIN({DAY}) AS min_transaction_date, MAX({DAY}) AS max_transaction_date, COUNT(*) AS total_rows,
       {tally(dirty('date'))} AS missing_or_dirty_date_rows, {pct(tally(dirty('date')), 'COUNT(*)')} AS missing_or_dirty_date_pct FROM transactions""")
for key, name, pattern in (("d03_monthly_rows", "transaction_month", "%Y-%m"), ("d14_yearly_rows", "transaction_year", "%Y")):
    add(key, f"SELECT strftime({DAY}, '{pattern}') AS {name}, COUNT(*) AS row_count FROM transactions WHERE NOT {dirty('date')} GROUP BY 1")
for key, name in (("d04_transaction_types", "transaction_type"), ("d05_payment_methods", "payment_method")):
    add(key, f"""
SELECT *, {pct('row_count', '(SELECT COUNT(*) FROM transactions)')} AS row_pct
FROM (SELECT {shown(name)} AS {name}, COUNT(*) AS row_count FROM transactions GROUP BY 1)""")
add("d06_column_report", "\nUNION ALL ".join(
    f"SELECT {i} AS ordinal_position, '{c}' AS column_name, '{'bigint' if c == 'source_rowid' else 'string'}' AS declared_type, "
    f"'{'YES' if c == 'source_rowid' else 'NO'}' AS is_primary_key, COUNT({c}) AS rows_present FROM transactions"
    for i, c in enumerate(["source_rowid", *s.RAW])))
add("d07_dictionary_report", "\nUNION ALL ".join(
    f"SELECT '{c.name}' AS column_name, '{c.meaning}' AS business_meaning, COUNT({c.name}) AS rows_present FROM transactions" for c in s.RAW_COLUMNS))
add("d08_distinct_identifiers", "SELECT COUNT(*) AS total_rows, " + ", ".join(
    f"COUNT(DISTINCT {c}) AS distinct_{c}" for c in ("invoice_id", "customer_id", "product_id", "sku", "store_id", "employee_id")) + " FROM transactions")
add("d09_completeness", "\nUNION ALL ".join(
    f"SELECT '{c.name}' AS column_name, '{c.label}' AS column_type, COUNT(*) AS total_rows, {tally(dirty(c.name))} AS missing_or_dirty_rows, "
    f"{pct(tally(dirty(c.name)), 'COUNT(*)')} AS missing_or_dirty_pct FROM transactions" for c in s.RAW_COLUMNS))


def breakdown(key, name, label, checks):
    add(key, "\nUNION ALL ".join(
        f"SELECT '{c}' AS {name}, {shown(c)} AS {label}, COUNT(*) AS row_count FROM transactions WHERE {check} GROUP BY 2" for c, check in checks.items()))


breakdown("d10_placeholder_values", "column_name", "dirty_value", {c: dirty(c) for c in s.PLACEHOLDER_REPORT})
OFF = f"abs(abs(a) - {rnd('p * q * (1 - d)', 2)}) > 0.05"
GAP = "(p IS NULL OR q IS NULL OR d IS NULL OR a IS NULL)"
add("d11_line_total_accuracy", f"""
SELECT COUNT(*) AS total_rows, {tally(GAP)} AS rows_not_checkable_due_to_missing_values,
       {tally(f'NOT {GAP} AND {OFF}')} AS possible_inaccurate_line_total_rows
FROM (SELECT {number('unit_price')} AS p, {number('quantity')} AS q, {number('discount')} AS d, {number('line_total')} AS a FROM transactions)""")
add("d12_invoice_total_accuracy", f"""
SELECT COUNT(*) AS invoices_checked, {tally('t IS NULL OR m > 0')} AS invoices_not_checkable_due_to_missing_values,
       {tally('t IS NOT NULL AND m = 0 AND abs(t - x) > 0.05')} AS possible_inaccurate_invoice_total_count
FROM (SELECT MAX({number('invoice_total')}) AS t, {rnd(total(number('line_total')), 2)} AS x, {tally(number('line_total') + ' IS NULL')} AS m
      FROM transactions WHERE NOT {dirty('invoice_id')} GROUP BY invoice_id)""")
add("d13_date_parseability", f"""
SELECT COUNT(*) AS total_rows, MIN({DAY}) AS min_parseable_date, MAX({DAY}) AS max_parseable_date,
       {tally(dirty('date'))} AS missing_or_dirty_date_rows, {tally(f"NOT {dirty('date')} AND {DAY} IS NULL")} AS unparsable_date_rows FROM transactions""")
CONSISTENT = {
    "customer_id": "customers", "store_id": "stores", "employee_id": "employees", "date": "datetimes",
    "payment_method": "payment_methods", "invoice_total": "invoice_totals",
}
add("d15_invoice_consistency", f"""
SELECT COUNT(*) AS invoices_checked, {', '.join(f"{tally(f'n_{c} > 1')} AS invoices_with_multiple_{n}" for c, n in CONSISTENT.items())}
FROM (SELECT {', '.join(f"COUNT(DISTINCT CASE WHEN NOT {dirty(c)} THEN {real(c) if c == 'invoice_total' else c} END) AS n_{c}" for c in CONSISTENT)}
      FROM transactions WHERE NOT {dirty('invoice_id')} GROUP BY invoice_id)""")
add("d16_duplicate_line_numbers", f"""
SELECT invoice_id, line_no, COUNT(*) AS duplicate_rows FROM transactions WHERE NOT {dirty('invoice_id')} AND line_no IS NOT NULL
GROUP BY ALL HAVING COUNT(*) > 1 ORDER BY duplicate_rows DESC, invoice_id, line_no LIMIT 50""")
add("d17_recoverable_products", f"""
SELECT COUNT(*) AS total_rows, {tally(dirty('product_id'))} AS missing_product_id_rows,
       {tally(f"{dirty('product_id')} AND NOT {dirty('sku')}")} AS missing_product_id_but_sku_available_rows FROM transactions""")


def outside(c, allowed):
    return f"({c} IS NULL OR trim({c}) NOT IN {listed(allowed)})"


def stated(c):
    return f"({c} IS NOT NULL AND trim({c}) NOT IN ('', 'unknown'))"


breakdown("d18_invalid_domain_values", "field_name", "invalid_value", {
    "transaction_type": outside("transaction_type", s.TRANSACTION_TYPES), "payment_method": outside("payment_method", s.PAYMENT_METHODS),
    "currency": outside("currency", s.CURRENCIES), "discount": f"NOT {stated('discount')} OR {real('discount')} NOT BETWEEN 0 AND 1",
})
add("d19_invalid_numbers", f"""
SELECT {tally(f"{stated('unit_price')} AND {real('unit_price')} < 0")} AS negative_unit_price_rows,
       {tally(f"{stated('quantity')} AND {real('quantity')} <= 0")} AS non_positive_quantity_rows,
       {tally(f"{stated('discount')} AND {real('discount')} NOT BETWEEN 0 AND 1")} AS invalid_discount_rows,
       {tally(f"{stated('invoice_total')} AND {real('invoice_total')} = -1")} AS invoice_total_placeholder_minus_one_rows FROM transactions""")

# ---- cleaning ----
NAMES = [("transaction_datetime" if c == "date" else c) for c in s.RAW]
NZ = "nz AS MATERIALIZED (SELECT source_rowid, " + ", ".join(f"{value(c)} AS {n}" for c, n in zip(s.RAW, NAMES)) + " FROM transactions)"
CRITICAL = " OR ".join(f"{c} IS NULL" for c in s.CRITICAL_COLUMNS)
VIEW = NZ + f""",
vw AS (SELECT * REPLACE (COALESCE(currency, 'USD') AS currency, COALESCE(currency_symbol, '$') AS currency_symbol),
              {strict_day('transaction_datetime')} AS transaction_date, CASE WHEN {CRITICAL} THEN 1 ELSE 0 END AS has_critical_issue FROM nz),
cln AS (SELECT * EXCLUDE (has_critical_issue) REPLACE (COALESCE(customer_id, 'UNKNOWN_CUSTOMER') AS customer_id,
               {rnd('COALESCE(line_total, unit_price * quantity * (1 - COALESCE(discount, 0)))', 2)} AS line_total)
        FROM vw WHERE has_critical_issue = 0)"""
add("c01_normalise", "SELECT * EXCLUDE (has_critical_issue) FROM vw", VIEW)
add("c02_critical_flag", "SELECT source_rowid, has_critical_issue FROM vw", VIEW)
add("c03_clean_rows", "SELECT * FROM cln", VIEW)
add("c04_rejected_rows", "SELECT * FROM vw WHERE has_critical_issue = 1", VIEW)


def orphans(lines: str, masters: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{k}' AS field, {k} AS invalid_value, COUNT(*) AS cnt FROM {lines} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM {m}) GROUP BY {k}"
        for k, m in masters.items())


MASTERS = {"customer_id": "customers", "product_id": "products", "store_id": "stores", "employee_id": "employees"}
add("c05_orphan_keys", orphans("cln", MASTERS), VIEW)
AGREED = ", ".join(f"CASE WHEN COUNT(DISTINCT {c}) = 1 THEN MAX({c}) END AS invoice_{c}" for c in s.INVOICE_ATTRIBUTES)
FACTS = NZ + f""",
iv AS MATERIALIZED (SELECT invoice_id, {AGREED} FROM nz WHERE invoice_id IS NOT NULL GROUP BY invoice_id),
pm AS (SELECT product_id, unit_price FROM nz WHERE product_id IS NOT NULL AND unit_price IS NOT NULL GROUP BY product_id, unit_price
       QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY COUNT(*) DESC, unit_price DESC) = 1),
qm AS (SELECT product_id, quantity FROM nz WHERE product_id IS NOT NULL AND quantity > 0 GROUP BY product_id, quantity
       QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY COUNT(*) DESC, quantity) = 1),
gq AS (SELECT quantity FROM nz WHERE quantity > 0 GROUP BY quantity ORDER BY COUNT(*) DESC, quantity LIMIT 1),
sp AS (SELECT source_rowid, sku, regexp_extract(sku, '[0-9]+', 0) AS product_id FROM nz
       WHERE product_id IS NULL AND sku IS NOT NULL AND regexp_extract(sku, '[0-9]+', 0) IN (SELECT product_id FROM products)),
ln AS (SELECT source_rowid, invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY source_rowid) AS invoice_row_number
       FROM nz WHERE invoice_id IS NOT NULL)"""
add("c06_invoice_consensus", "SELECT * FROM iv", FACTS)
add("c07_price_modes", "SELECT * FROM pm", FACTS)
add("c08_quantity_modes", "SELECT * FROM qm", FACTS)
add("c09_common_quantity", "SELECT * FROM gq", FACTS)
add("c10_sku_products", "SELECT * FROM sp", FACTS)
add("c11_return_customers", """
SELECT r.invoice_id, i.invoice_customer_id AS sale_customer_id FROM (SELECT DISTINCT invoice_id FROM nz WHERE invoice_id ILIKE 'RET-%') r
JOIN iv i ON i.invoice_id = 'INV-' || substr(r.invoice_id, 5) WHERE i.invoice_customer_id IS NOT NULL""", FACTS)
add("c12_line_numbers", "SELECT * FROM ln", FACTS)
OWN_OR_AGREED = ", ".join(
    f"COALESCE(n.{c}, i.invoice_{c}) AS {c}" for c in ("transaction_datetime", "employee_id", "transaction_type", "payment_method", "invoice_total"))
PAID, KEPT = "abs(line_total)", "(1 - discount)"


def near_int(x):
    return f"CASE WHEN abs({x} - {rnd(x, 0)}) < 0.01 THEN CAST({rnd(x, 0)} AS BIGINT) END"


QUOT = f"({PAID} / NULLIF(unit_price * {KEPT}, 0))"
FREE = f"(1 - {PAID} / NULLIF(unit_price * quantity, 0))"
CHAIN = FACTS + f""",
fb AS (SELECT n.source_rowid, n.invoice_id, COALESCE(n.line_no, ln.invoice_row_number) AS line_no,
         COALESCE(n.customer_id, i.invoice_customer_id, CASE WHEN n.invoice_id ILIKE 'RET-%' THEN ic.invoice_customer_id END) AS customer_id,
         COALESCE(n.product_id, sp.product_id) AS product_id, n.size, n.color, n.unit_price, n.quantity, n.discount, n.line_total,
         COALESCE(n.store_id, i.invoice_store_id) AS store_id, COALESCE(n.currency, i.invoice_currency, 'USD') AS currency,
         COALESCE(n.currency_symbol, i.invoice_currency_symbol, '$') AS currency_symbol, n.sku, {OWN_OR_AGREED}
       FROM nz n JOIN iv i USING (invoice_id) JOIN ln USING (source_rowid) LEFT JOIN sp USING (source_rowid)
       LEFT JOIN iv ic ON ic.invoice_id = 'INV-' || substr(n.invoice_id, 5)),
ff AS (SELECT b.* REPLACE (COALESCE(b.color, p.color) AS color, COALESCE(b.store_id, e.store_id) AS store_id),
         pm.unit_price AS mp, qm.quantity AS mq, (SELECT quantity FROM gq) AS gm
       FROM fb b LEFT JOIN products p USING (product_id) LEFT JOIN employees e USING (employee_id)
       LEFT JOIN pm USING (product_id) LEFT JOIN qm USING (product_id)),
fd AS (SELECT *, CASE WHEN unit_price IS NULL THEN {rnd(f'{PAID} / NULLIF(quantity * {KEPT}, 0)', 2)} END AS unit_price_from_formula,
         CASE WHEN quantity IS NULL THEN {near_int(QUOT)} END AS quantity_from_formula,
         CASE WHEN discount IS NULL AND {FREE} BETWEEN 0 AND 1 THEN {rnd(FREE, 4)} END AS discount_from_formula FROM ff),
fs AS (SELECT * REPLACE (COALESCE(size, 'Unknown') AS size, COALESCE(color, 'Not specified') AS color,
         COALESCE(unit_price, unit_price_from_formula, mp) AS unit_price, COALESCE(quantity, quantity_from_formula, mq, gm) AS quantity,
         COALESCE(discount, discount_from_formula, 0.0) AS discount), {strict_day('transaction_datetime')} AS transaction_date FROM fd),
ft AS (SELECT * REPLACE ({rnd("COALESCE(line_total, (CASE WHEN transaction_type = 'Return' THEN -1 ELSE 1 END) * unit_price * quantity * (1 - discount))", 2)} AS line_total) FROM fs),
fw AS (SELECT *, COUNT(*) FILTER (WHERE line_total IS NULL) OVER w AS gaps, COUNT(line_total) OVER w AS known_n,
         COALESCE(CAST(SUM(CAST(line_total AS DECIMAL(20,6))) OVER w AS DOUBLE), 0.0) AS known,
         CASE WHEN MIN(invoice_total) OVER w = MAX(invoice_total) OVER w THEN MAX(invoice_total) OVER w END AS agreed
       FROM ft WINDOW w AS (PARTITION BY invoice_id)),
fg AS (SELECT *, CASE WHEN gaps = 1 THEN {rnd('agreed - known', 2)} END AS gap FROM fw),
fr AS (SELECT *, CASE WHEN line_total IS NULL THEN gap END AS line_total_from_invoice_residual,
         CASE WHEN gap IS NOT NULL THEN {rnd('known + gap', 2)} WHEN gaps = 0 THEN {rnd('known', 2)} END AS computed FROM fg),
fi AS (SELECT source_rowid, invoice_id, line_no, COALESCE(customer_id, 'UNKNOWN_CUSTOMER') AS customer_id, product_id, size, color, unit_price,
         COALESCE(quantity, {near_int('(abs(line_total_from_invoice_residual) / NULLIF(unit_price * (1 - discount), 0))')}) AS quantity,
         transaction_datetime, transaction_date, discount, COALESCE(line_total, line_total_from_invoice_residual) AS line_total, store_id,
         COALESCE(employee_id, 'UNKNOWN_STORE_' || COALESCE(store_id, 'UNKNOWN')) AS employee_id, currency, currency_symbol,
         COALESCE(sku, 'Not available') AS sku, transaction_type, COALESCE(payment_method, 'Unknown') AS payment_method,
         COALESCE(invoice_total, computed) AS invoice_total, {', '.join(f'CAST({c} IS NOT NULL AS INTEGER) AS has_{c}' for c in ('line_no', 'customer_id', 'product_id', 'unit_price'))},
         CAST(quantity IS NOT NULL OR line_total_from_invoice_residual IS NOT NULL AS INTEGER) AS has_quantity
       FROM fr WHERE transaction_datetime IS NOT NULL AND transaction_type IS NOT NULL),
tf AS (SELECT * REPLACE (COALESCE(product_id, 'UNKNOWN_PRODUCT') AS product_id, COALESCE(store_id, 'UNKNOWN_STORE') AS store_id,
         COALESCE(unit_price, 0.0) AS unit_price, COALESCE(quantity, 0) AS quantity, COALESCE(line_total, 0.0) AS line_total,
         COALESCE(invoice_total, 0.0) AS invoice_total, CAST(customer_id <> 'UNKNOWN_CUSTOMER' AS INTEGER) AS has_customer_id,
         CAST(COALESCE(product_id, 'UNKNOWN_PRODUCT') <> 'UNKNOWN_PRODUCT' AS INTEGER) AS has_product_id,
         CAST(COALESCE(unit_price, 0.0) <> 0 AS INTEGER) AS has_unit_price, CAST(COALESCE(quantity, 0) <> 0 AS INTEGER) AS has_quantity) FROM fi)"""
FILLED = ", ".join(["source_rowid", *NAMES])
add("c13_filled", f"SELECT {FILLED} FROM ff", CHAIN)
add("c14_derived_amounts", "SELECT source_rowid, unit_price_from_formula, quantity_from_formula, discount_from_formula FROM fd", CHAIN)
add("c15_settled_values", "SELECT source_rowid, size, color, unit_price, quantity, transaction_date, discount FROM fs", CHAIN)
add("c16_line_totals", "SELECT source_rowid, line_total FROM ft", CHAIN)
add("c17_residuals", "SELECT source_rowid, invoice_id, line_total_from_invoice_residual FROM fr", CHAIN)
add("c18_imputed", "SELECT * FROM fi", CHAIN)
add("c19_without_duplicates", f"""
SELECT MIN(source_rowid) AS source_rowid, {', '.join(s.RAW)} FROM (
  SELECT * FROM transactions UNION ALL SELECT * REPLACE (-source_rowid - 1 AS source_rowid) FROM transactions) GROUP BY {', '.join(s.RAW)}""")
FINAL_DIMS = """
employees_final AS (
  SELECT employee_id, store_id, name, position FROM employees
  UNION ALL SELECT 'UNKNOWN_STORE_' || store_id, store_id, 'Unknown Employee - Store ' || store_id, 'Unknown' FROM stores
  UNION ALL SELECT 'UNKNOWN_STORE_UNKNOWN', NULL, 'Unknown Employee - Unknown Store', 'Unknown'),
customers_final AS (
  SELECT * FROM customers
  UNION ALL SELECT 'UNKNOWN_CUSTOMER', 'Unknown Customer', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', NULL, 'Unknown'),
products_final AS (
  SELECT * REPLACE (COALESCE(color, 'Not specified') AS color, COALESCE(size, 'Unknown') AS size) FROM products
  UNION ALL SELECT 'UNKNOWN_PRODUCT', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Not specified', 'Unknown', NULL),
stores_final AS (
  SELECT * FROM stores UNION ALL SELECT 'UNKNOWN_STORE', 'Unknown', 'Unknown', 'Unknown Store', NULL, 'Unknown', NULL, NULL)"""
for key, table in (("c20", "employees"), ("c21", "customers"), ("c22", "products"), ("c23", "stores")):
    add(f"{key}_final_{table}", f"SELECT * FROM {table}_final", FINAL_DIMS)
ORPHANS_FINAL = orphans("tf", {k: m + "_final" for k, m in MASTERS.items()})
add("c05_orphan_keys_final", ORPHANS_FINAL, CHAIN + "," + FINAL_DIMS)
add("c24_final_transactions", "SELECT * FROM tf", CHAIN)
add("c25_cleaning_summary", f"""
SELECT 'raw_rows' AS metric, COUNT(*) AS value FROM transactions UNION ALL SELECT 'final_rows', COUNT(*) FROM tf
UNION ALL SELECT 'invalid_foreign_key_rows', {bigint('COALESCE(SUM(cnt), 0)')} FROM ({ORPHANS_FINAL})""", CHAIN + "," + FINAL_DIMS)
CORE = ("customer_id", "product_id", "unit_price", "quantity", "line_total", "invoice_total")


def figures(stage, table, columns, gaps, revenue):
    missing = " + ".join(f"COUNT(*) FILTER (WHERE {g})" for g in gaps)
    return f"""SELECT '{stage}' AS stage, COUNT(*) AS rows, {pct(f'({missing})', '(COUNT(*) * 6)')} AS missing_core_pct,
       COUNT(*) - COUNT(DISTINCT ({', '.join(columns)})) AS duplicate_rows,
       {total(f"(CASE WHEN lower(trim(transaction_type)) = 'return' THEN -1 ELSE 1 END) * abs({revenue})")} AS revenue FROM {table}"""


add("c26_before_after", figures("before", "transactions", list(s.RAW), [dirty(c) for c in CORE], number("line_total")) + "\nUNION ALL "
    + figures("after", "tf", [c for c in s.FINAL_COLUMNS if c != "source_rowid"],
              ["customer_id = 'UNKNOWN_CUSTOMER'", "product_id = 'UNKNOWN_PRODUCT'", *[f"{c} IS NULL" for c in CORE[2:]]], "line_total"), CHAIN)

CLEANING = O
