"""DuckDB text of the table binding and of the shared derived tables.

Written independently of the DataFrame code: windows and plain joins here, against
grouped summaries and adaptive joins there.
"""

from __future__ import annotations


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(38,6))"


def total(x: str) -> str:
    return f"CAST(SUM({dec(x)}) AS DOUBLE)"


def total0(x: str) -> str:
    return f"COALESCE({total(x)}, 0.0)"


def mean(x: str) -> str:
    return f"({total(x)} / NULLIF(CAST(COUNT({x}) AS DOUBLE), 0))"


def rnd(x: str, places: int) -> str:
    small = f"CAST(ROUND(TRY_CAST({x} AS DECIMAL(24,9)), {places}) AS DOUBLE)"
    return f"(CASE WHEN abs({x}) < 9e14 THEN {small} ELSE ROUND({x}, {places}) END)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def tally(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def bigint(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def pct(part: str, whole: str) -> str:
    return rnd(f"(CAST({part} AS DOUBLE) * 100 / NULLIF({whole}, 0))", 2)


def bands(x: str, edges, include_lowest: bool = False) -> str:
    parts = []
    for i, (lo, hi, label) in enumerate(edges):
        op = ">=" if include_lowest and i == 0 else ">"
        upper = "" if hi is None else f" AND {x} <= {hi}"
        parts.append(f"WHEN {x} {op} {lo}{upper} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def quartile_label(x: str, labels, edges: str) -> str:
    """Label by the five-edge list column ``edges``; tied edges mean four equal widths."""
    a, b, c, d = labels
    lo, hi = f"{edges}[1]", f"{edges}[5]"
    tied = f"len(list_distinct({edges})) < 5"

    def cut(i):
        return f"(CASE WHEN {tied} THEN {lo} + ({hi} - {lo}) / 4.0::DOUBLE * {i}.0::DOUBLE ELSE {edges}[{i + 1}] END)"

    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {lo} = {hi} THEN '{b}' WHEN {x} <= {cut(1)} THEN '{a}' "
        f"WHEN {x} <= {cut(2)} THEN '{b}' WHEN {x} <= {cut(3)} THEN '{c}' ELSE '{d}' END"
    )


def quartiles(x: str) -> str:
    return f"quantile_cont({x}, [0.0, 0.25, 0.5, 0.75, 1.0])"


BINDING = """
bl AS (
  SELECT *, CAST((l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 101 AS INTEGER) AS h,
         CAST(o_orderkey % (SELECT COUNT(*) FROM supplier) AS VARCHAR) AS store_no,
         md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
             CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), CAST(l_shipdate AS DATE))) AS digest,
         CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) + 5000 * (l_linenumber % 3) AS price_cents,
         CAST(floor(l_discount * 100 + 0.5) AS INTEGER) * 6 AS percent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
bb AS (
  SELECT h, CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS source_rowid,
         (CASE WHEN l_returnflag = 'R' THEN 'RET-' ELSE 'INV-' END) || l_orderkey AS invoice_id,
         l_linenumber AS line_no, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_partkey AS VARCHAR) AS product_id,
         CASE p_size % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END AS size,
         split_part(p_name, ' ', 1) AS color,
         p_retailprice + 50 * (l_linenumber % 3) AS unit_price,
         CAST(l_quantity AS INTEGER) % 12 + 1 AS quantity,
         CAST(percent AS DOUBLE) / 100 AS discount,
         (price_cents * (CAST(l_quantity AS INTEGER) % 12 + 1) * (100 - percent) + 50) // 100 AS cents,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:00' AS transaction_datetime,
         CAST(o_orderdate AS DATE) AS transaction_date,
         store_no AS store_id, store_no || '-' || (o_orderkey % 7) AS employee_id,
         'SK' || l_partkey || '-' || p_size AS sku,
         CASE WHEN l_returnflag = 'R' THEN 'Return' ELSE 'Sale' END AS transaction_type,
         CASE WHEN o_orderstatus = 'F' THEN 'Cash' ELSE 'Credit Card' END AS payment_method
  FROM bl),
bt AS (
  SELECT *, (CASE WHEN transaction_type = 'Return' THEN -cents ELSE cents END) / 100.0::DOUBLE AS line_total FROM bb),
bf AS (SELECT *, CAST(SUM(CAST(line_total AS DECIMAL(20,6))) OVER (PARTITION BY invoice_id) AS DOUBLE) AS invoice_total FROM bt)"""

FACT = """
fact AS (
  SELECT source_rowid, invoice_id, line_no,
         CASE WHEN h IN (3, 4, 5) THEN 'UNKNOWN_CUSTOMER' WHEN h = 6 THEN '99999999' ELSE customer_id END AS customer_id,
         CASE h WHEN 12 THEN 'UNKNOWN_PRODUCT' WHEN 13 THEN '88888888' ELSE product_id END AS product_id,
         size, color, unit_price, quantity, transaction_datetime, transaction_date, discount, line_total,
         CASE h WHEN 80 THEN 'UNKNOWN_STORE' WHEN 81 THEN '77777777' ELSE store_id END AS store_id,
         employee_id, 'USD' AS currency, '$' AS currency_symbol, sku, transaction_type, payment_method, invoice_total,
         1 AS has_line_no, 1 AS has_customer_id, 1 AS has_product_id, 1 AS has_unit_price, 1 AS has_quantity
  FROM bf)"""

RAW = """
transactions AS (
  SELECT source_rowid,
    CASE h WHEN 1 THEN NULL WHEN 2 THEN 'N/A' ELSE invoice_id END AS invoice_id,
    CASE h WHEN 99 THEN '-1' ELSE CAST(line_no AS VARCHAR) END AS line_no,
    CASE h WHEN 3 THEN '-1' WHEN 4 THEN '' WHEN 5 THEN 'unknown' WHEN 6 THEN '99999999' WHEN 100 THEN '  ' || customer_id || ' ' ELSE customer_id END AS customer_id,
    CASE WHEN h IN (10, 52) THEN 'unknown' WHEN h = 11 THEN 'N/A' WHEN h = 12 THEN NULL WHEN h = 13 THEN '88888888' ELSE product_id END AS product_id,
    CASE h WHEN 15 THEN '' ELSE size END AS size,
    CASE h WHEN 16 THEN NULL ELSE color END AS color,
    CASE h WHEN 20 THEN '-1' WHEN 21 THEN 'unknown' WHEN 22 THEN '' WHEN 23 THEN 'N/A' WHEN 52 THEN 'unknown' ELSE CAST(unit_price AS VARCHAR) END AS unit_price,
    CASE h WHEN 30 THEN '-1' WHEN 31 THEN NULL WHEN 32 THEN 'unknown' ELSE CAST(quantity AS VARCHAR) END AS quantity,
    CASE h WHEN 60 THEN NULL WHEN 61 THEN 'unknown' WHEN 62 THEN '2023/01/05' ELSE transaction_datetime END AS date,
    CASE h WHEN 40 THEN '-1' WHEN 41 THEN '' WHEN 42 THEN '1.5' ELSE CAST(discount AS VARCHAR) END AS discount,
    CASE h WHEN 50 THEN '-1' WHEN 51 THEN NULL WHEN 52 THEN 'unknown' WHEN 53 THEN CAST(line_total + 1 AS VARCHAR) ELSE CAST(line_total AS VARCHAR) END AS line_total,
    CASE h WHEN 80 THEN '-1' ELSE store_id END AS store_id,
    CASE h WHEN 85 THEN '' WHEN 86 THEN 'unknown' ELSE employee_id END AS employee_id,
    CASE h WHEN 87 THEN NULL WHEN 89 THEN 'EUR' ELSE 'USD' END AS currency,
    CASE h WHEN 88 THEN '' ELSE '$' END AS currency_symbol,
    CASE h WHEN 14 THEN ' ' WHEN 11 THEN 'N/A' WHEN 52 THEN 'N/A' ELSE sku END AS sku,
    CASE h WHEN 90 THEN '' WHEN 91 THEN 'sale' ELSE transaction_type END AS transaction_type,
    CASE h WHEN 95 THEN 'N/A' WHEN 96 THEN 'PayPal' ELSE payment_method END AS payment_method,
    CASE h WHEN 97 THEN '-1' WHEN 98 THEN NULL ELSE CAST(invoice_total AS VARCHAR) END AS invoice_total
  FROM bf)"""

DIMENSIONS = """
places AS (SELECT n_nationkey, n_name AS city, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey),
customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name, 'c' || c_custkey || '@example.com' AS email,
         '555-' || c_custkey AS telephone, city, country,
         CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender,
         DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS date_of_birth, c_mktsegment AS job_title
  FROM customer JOIN places ON c_nationkey = n_nationkey),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS category, p_brand AS sub_category,
         p_name AS description_pt, p_name AS description_de, p_name AS description_fr, p_name AS description_es,
         p_name AS description_en, p_name AS description_zh, split_part(p_name, ' ', 1) AS color,
         CASE p_size % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END AS size,
         p_retailprice * (p_size % 10) / 10 AS production_cost
  FROM part),
stores AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS store_id, country, city, s_name AS store_name,
         CAST(s_suppkey % 22 AS INTEGER) AS number_of_employees, CAST(s_suppkey AS VARCHAR) AS zip_code,
         CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude
  FROM supplier JOIN places ON s_nationkey = n_nationkey),
employees AS (
  SELECT s_suppkey || '-' || n AS employee_id, CAST(s_suppkey AS VARCHAR) AS store_id,
         'Employee ' || n || ' of ' || s_name AS name, CASE WHEN n = 0 THEN 'Manager' ELSE 'Seller' END AS position
  FROM supplier, (SELECT unnest([0, 1, 2, 3, 4, 6]) AS n)),
pairs AS (
  SELECT p_type, p_brand, (CAST(substr(p_brand, 7, 2) AS INTEGER) % 3 + 1) * 10 AS rate, y
  FROM (SELECT DISTINCT p_type, p_brand FROM part), (SELECT unnest(range(1995, 2002)) AS y)),
discounts AS (
  SELECT CAST((y - 1995) * 2 + 1 AS INTEGER) AS campaign_seq, y || '-11-20 00:00:00' AS "start", y || '-12-05 00:00:00' AS "end",
         CAST(CAST(rate AS DOUBLE) / 100 AS VARCHAR) AS discount, p_type AS category, p_brand AS sub_category, 'Black Friday' AS description
  FROM pairs
  UNION ALL
  SELECT CAST((y - 1995) * 2 + 2 AS INTEGER), y || '-12-01 00:00:00', CASE WHEN y = 2001 THEN 'n/a' ELSE y || '-12-31 00:00:00' END,
         CASE WHEN y = 1999 THEN 'unknown' ELSE CAST(CAST(rate + 15 AS DOUBLE) / 100 AS VARCHAR) END, p_type, p_brand, 'Holiday'
  FROM pairs)"""
