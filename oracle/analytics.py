"""DuckDB twins of the feature and report queries on the clean fact table."""

from __future__ import annotations

from itertools import product

from oracle.base import (
    BINDING, DIMENSIONS, FACT, RAW, bands, bigint, mean, quartile_label, quartiles, ratio, rnd, total, total0,
)
from oracle import rules as s

LINES = f"""
li AS (
  SELECT g.*, gross_sales * discount AS discount_amount,
         CASE WHEN is_return THEN -abs(line_total) ELSE abs(line_total) END AS revenue,
         CAST(year(transaction_date) AS INTEGER) AS year, strftime(transaction_date, '%Y-%m') AS month,
         year(transaction_date) || 'Q' || quarter(transaction_date) AS quarter,
         CAST(day(transaction_date) AS INTEGER) AS day, dayname(transaction_date) AS weekday,
         CAST(isodow(transaction_date) - 1 AS INTEGER) AS weekday_ord, isodow(transaction_date) >= 6 AS is_weekend,
         {bands('discount', s.DISCOUNT_BANDS)} AS discount_group
  FROM (SELECT *, unit_price * quantity AS gross_sales, coalesce(lower(trim(transaction_type)) = 'return', false) AS is_return
        FROM fact
        WHERE transaction_date IS NOT NULL AND invoice_id IS NOT NULL AND unit_price IS NOT NULL AND quantity IS NOT NULL
          AND discount IS NOT NULL AND line_total IS NOT NULL) g),
inv AS (
  SELECT invoice_id, MIN(transaction_date) AS order_date, {total0('revenue')} AS order_revenue,
         {total0('gross_sales')} AS order_gross_sales, {total0('discount_amount')} AS order_discount_amount,
         {bigint('SUM(quantity)')} AS order_quantity, COUNT(DISTINCT line_no) AS line_count,
         COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT customer_id) AS unique_customers,
         bool_or(is_return) AS has_return
  FROM li GROUP BY invoice_id),
pl AS (
  SELECT q.*, revenue - cost_impact AS gross_profit, {ratio('(revenue - cost_impact)', 'revenue')} AS profit_margin
  FROM (SELECT l.*, coalesce(p.category, 'Unknown') AS category, coalesce(p.sub_category, 'Unknown') AS sub_category,
               coalesce(p.description_en, 'Unknown Product') AS product_name,
               coalesce(p.color, 'Unknown') AS product_master_color, coalesce(p.size, 'Unknown') AS available_sizes,
               coalesce(p.production_cost, 0.0) AS production_cost,
               CASE WHEN is_return THEN -abs(quantity) ELSE abs(quantity) END AS signed_quantity,
               CASE WHEN is_return THEN 0 ELSE quantity END AS units_sold,
               CASE WHEN is_return THEN quantity ELSE 0 END AS units_returned,
               coalesce(p.production_cost, 0.0) * CASE WHEN is_return THEN -abs(quantity) ELSE abs(quantity) END AS cost_impact
        FROM li l LEFT JOIN products p ON l.product_id = p.product_id) q),
pk AS (SELECT * FROM pl WHERE NOT (upper(product_id) = 'UNKNOWN_PRODUCT' OR category = 'Unknown')),
sl AS (
  SELECT l.*, coalesce(t.store_name, 'Unknown Store') AS store_name, coalesce(t.country, 'Unknown') AS country,
         coalesce(t.city, 'Unknown') AS city, coalesce(t.zip_code, 'Unknown') AS zip_code,
         CAST(coalesce(t.number_of_employees, 0) AS DOUBLE) AS number_of_employees
  FROM pl l LEFT JOIN stores t ON l.store_id = t.store_id),
sk AS (SELECT * FROM sl WHERE NOT (store_name = 'Unknown Store' OR country = 'Unknown')),
active AS (
  SELECT * FROM (
    SELECT campaign_seq, TRY_CAST("start" AS TIMESTAMP) AS "start", TRY_CAST("end" AS TIMESTAMP) AS "end",
           TRY_CAST(discount AS DOUBLE) AS discount, category, sub_category, description FROM discounts)
  WHERE "start" IS NOT NULL AND "end" IS NOT NULL AND discount IS NOT NULL AND category IS NOT NULL AND sub_category IS NOT NULL),
won AS (
  SELECT source_rowid, description AS campaign_description, a.discount AS campaign_discount
  FROM pl l JOIN active a ON l.category = a.category AND l.sub_category = a.sub_category
    AND CAST(transaction_date AS TIMESTAMP) BETWEEN "start" AND "end"
  QUALIFY row_number() OVER (PARTITION BY source_rowid ORDER BY campaign_seq DESC) = 1),
dl AS (
  SELECT c.*, discount > 0 AS has_discount, discount - campaign_discount AS discount_gap,
         CASE WHEN is_campaign_period AND discount > 0 THEN 'Campaign Discount'
              WHEN is_campaign_period THEN 'Campaign Listed / No Discount Applied'
              WHEN discount > 0 THEN 'Non-Campaign Discount' ELSE 'No Discount' END AS discount_status
  FROM (SELECT l.*, CASE WHEN w.source_rowid IS NULL THEN 'No Campaign' ELSE w.campaign_description END AS campaign_description,
               coalesce(w.campaign_discount, 0.0) AS campaign_discount, w.source_rowid IS NOT NULL AS is_campaign_period
        FROM pl l LEFT JOIN won w USING (source_rowid)) c),
cs AS (
  SELECT customer_id, {total0('revenue')} AS customer_revenue, COUNT(DISTINCT invoice_id) AS customer_orders,
         MIN(transaction_date) AS first_purchase, MAX(transaction_date) AS last_purchase,
         {total0('revenue')} / COUNT(DISTINCT invoice_id) AS "customer_AOV"
  FROM li WHERE customer_id IS NOT NULL GROUP BY customer_id),
ck AS (SELECT * FROM cs WHERE upper(customer_id) <> 'UNKNOWN_CUSTOMER'),
lk AS (SELECT * FROM li WHERE upper(customer_id) <> 'UNKNOWN_CUSTOMER')"""

PRELUDE = "WITH " + ",".join([BINDING, FACT, DIMENSIONS, LINES])
RAW_PRELUDE = "WITH " + ",".join([BINDING, RAW, DIMENSIONS])

O: dict[str, str] = {}


def add(key: str, body: str, extra: str = "") -> None:
    O[key] = PRELUDE + (f",\n{extra}" if extra else "") + "\n" + body


# ---- sources ----
add("s01_load_fact", f"SELECT {', '.join(s.FINAL_COLUMNS)} FROM fact")
O["s08_row_ids"] = (
    "SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS source_rowid, o_orderkey, o_custkey, o_orderdate FROM orders"
)

# ---- features ----
NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
ISO = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$'"


def strict_number(c):
    return f"CASE WHEN regexp_matches(trim({c}), {NUM}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def strict_day(c):
    return f"CASE WHEN regexp_matches({c}, {ISO}) THEN CAST(TRY_CAST({c} AS TIMESTAMP) AS DATE) END"


COERCED = (
    f"co AS (SELECT source_rowid, invoice_id, {strict_day('date')} AS transaction_date, "
    + ", ".join(f"{strict_number(c)} AS {c}" for c in ("unit_price", "quantity", "discount", "line_total"))
    + " FROM transactions)"
)
O["f01_coerce_types"] = f"{RAW_PRELUDE},\n{COERCED}\nSELECT * FROM co"
O["f02_drop_unusable"] = f"{RAW_PRELUDE},\n{COERCED}\nSELECT * FROM co WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in ("transaction_date", "invoice_id", "unit_price", "quantity", "discount", "line_total")
)
add("f03_sales_measures", "SELECT source_rowid, gross_sales, discount_amount FROM li")
add("f04_signed_revenue", "SELECT source_rowid, transaction_type, revenue FROM li")
add("f05_time_features", "SELECT source_rowid, year, month, quarter, day, weekday, is_weekend FROM li")
add("f06_is_return", "SELECT source_rowid, is_return FROM li")
PRICE_EDGES = f"pe AS (SELECT {quartiles('unit_price')} AS edges FROM li)"
PRICE_LABEL = quartile_label("unit_price", s.PRICE_SEGMENTS, "edges")
add("f07_price_segment", f"SELECT source_rowid, unit_price, {PRICE_LABEL} AS price_segment FROM li, pe", PRICE_EDGES)
add("f08_discount_group", "SELECT source_rowid, discount, discount_group FROM li")
add("f09_invoice_summary", "SELECT * FROM inv")
add("f10_item_value", f"SELECT invoice_id, {ratio('order_revenue', 'order_quantity')} AS avg_item_per_order FROM inv")
BASKET = bands("order_quantity", s.BASKET_BANDS, include_lowest=True)
add("f11_basket_group", f"SELECT invoice_id, order_quantity, {BASKET} AS basket_size_group FROM inv")
ORDER_LABEL = quartile_label("order_revenue", s.ORDER_VALUE_GROUPS, "edges")
add(
    "f12_order_value_group",
    f"SELECT invoice_id, order_revenue, {ORDER_LABEL} AS order_value_group FROM inv, oe",
    f"oe AS (SELECT {quartiles('order_revenue')} AS edges FROM inv)",
)
add("f13_weekday_order", "SELECT source_rowid, weekday, weekday_ord FROM li")

# ---- sales ----
UNITS = bigint("COALESCE(SUM(quantity), 0)")
add("a01_sales_overview", f"""
SELECT *, COALESCE({ratio('total_revenue', 'total_orders')}, 0.0) AS aov,
       COALESCE({ratio('total_revenue', 'total_units')}, 0.0) AS avg_revenue_per_unit,
       COALESCE({ratio('total_units', 'total_orders')}, 0.0) AS avg_items_per_order
FROM (SELECT {total0('revenue')} AS total_revenue, {total0('gross_sales')} AS total_gross_sales,
             {total0('discount_amount')} AS total_discount_amount, COUNT(DISTINCT invoice_id) AS total_orders,
             {UNITS} AS total_units, COUNT(*) FILTER (WHERE is_return) AS total_returns FROM li)""")
add("a02_monthly_revenue", f"SELECT month, {total0('revenue')} AS revenue FROM li GROUP BY month")
add("a03_quarterly_revenue", f"SELECT quarter, {total0('revenue')} AS revenue FROM li GROUP BY quarter")


def correlations(table: str, columns) -> str:
    cells = [
        f"SELECT '{x}' AS var_x, '{y}' AS var_y, {rnd(f'corr({x}, {y})', 6)} AS corr FROM {table}"
        for x, y in product(columns, columns)
    ]
    return "\nUNION ALL ".join(cells)


DRIVERS = ("revenue", "gross_sales", "quantity", "unit_price", "discount", "discount_amount")
ONCE = "mat AS MATERIALIZED (SELECT {cols} FROM {table})"
add("a04_revenue_driver_correlation", correlations("mat", DRIVERS), ONCE.format(cols=", ".join(DRIVERS), table="li"))
add("a05_order_statistics", "\nUNION ALL ".join(
    f"SELECT '{m}' AS metric, COUNT({m}) AS count, {rnd(mean(m), 4)} AS mean, {rnd(f'stddev_samp({m})', 4)} AS std, "
    f"CAST(MIN({m}) AS DOUBLE) AS min, "
    + ", ".join(f"{rnd(f'quantile_cont(CAST({m} AS DOUBLE), {q})', 4)} AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    + f", CAST(MAX({m}) AS DOUBLE) AS max FROM mat"
    for m in ("order_revenue", "order_quantity", "unique_products", "line_count")
), "mat AS MATERIALIZED (SELECT * FROM inv)")
add("a06_order_revenue_histogram", f"""
SELECT CAST(b + 1 AS INTEGER) AS bin, {rnd('low + (high - low) / 50.0::DOUBLE * b', 4)} AS bin_low,
       {rnd('low + (high - low) / 50.0::DOUBLE * (b + 1)', 4)} AS bin_high, COALESCE(n, 0) AS orders
FROM (SELECT unnest(range(50)) AS b) CROSS JOIN lim LEFT JOIN (
  SELECT least(CAST(floor((order_revenue - low) / (high - low) * 50.0::DOUBLE) AS INTEGER), 49) AS b, COUNT(*) AS n
  FROM inv, lim GROUP BY 1) USING (b)""",
    "lim AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS low, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS high "
    "FROM (SELECT MIN(order_revenue) AS lo, MAX(order_revenue) AS hi FROM inv))")


def order_of(x: str, labels) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{label}' THEN {i}" for i, label in enumerate(labels, 1)) + " END"


def labels_of(edges):
    return [label for _, _, label in edges]


add("a07_basket_analysis", f"""
SELECT basket_size_group, COUNT(*) AS orders, {total0('order_revenue')} AS revenue, {mean('order_revenue')} AS avg_order_value,
       {mean('unique_products')} AS avg_unique_products,
       {order_of('basket_size_group', labels_of(s.BASKET_BANDS))} AS basket_size_group_ord
FROM (SELECT *, {BASKET} AS basket_size_group FROM inv) GROUP BY basket_size_group""")
RQO = f"{total0('revenue')} AS revenue, {UNITS} AS quantity, COUNT(DISTINCT invoice_id) AS orders"
add("a08_weekday_sales", f"SELECT weekday, weekday_ord, {RQO} FROM li GROUP BY weekday, weekday_ord")
add("a09_weekend_sales", f"SELECT CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type, {RQO} FROM li GROUP BY 1")
add("a10_price_segment_sales", f"""
SELECT price_segment, {RQO}, {mean('unit_price')} AS avg_unit_price, {order_of('price_segment', s.PRICE_SEGMENTS)} AS price_segment_ord
FROM (SELECT *, {PRICE_LABEL} AS price_segment FROM li, pe) GROUP BY price_segment""", PRICE_EDGES)
add("a11_return_analysis", f"""
SELECT *, {ratio('return_rows', 'total_rows')} AS return_row_rate, {ratio('return_orders', 'total_orders')} AS return_order_rate
FROM (SELECT COUNT(*) FILTER (WHERE is_return) AS return_rows, COUNT(*) AS total_rows,
             COUNT(DISTINCT invoice_id) FILTER (WHERE is_return) AS return_orders, COUNT(DISTINCT invoice_id) AS total_orders,
             {total0('CASE WHEN is_return THEN revenue END')} AS return_revenue FROM li)""")
add("a12_sales_insights", f"""
SELECT total_revenue, total_orders, {ratio('total_revenue', 'total_orders')} AS aov,
       (SELECT month FROM mr ORDER BY revenue DESC, month LIMIT 1) AS peak_month, (SELECT MAX(revenue) FROM mr) AS peak_revenue,
       (SELECT month FROM mr ORDER BY revenue, month LIMIT 1) AS lowest_month, (SELECT MIN(revenue) FROM mr) AS lowest_revenue,
       corr_revenue_unit_price, corr_revenue_quantity, corr_revenue_discount
FROM (SELECT {total0('revenue')} AS total_revenue, COUNT(DISTINCT invoice_id) AS total_orders,
             {', '.join(f"{rnd(f'corr(revenue, {c})', 6)} AS corr_revenue_{c}" for c in ('unit_price', 'quantity', 'discount'))} FROM li)""",
    f"mr AS (SELECT month, {total0('revenue')} AS revenue FROM li GROUP BY month)")

# ---- customers ----
AGE = "CAST(date_diff('day', date_of_birth, DATE '2002-01-01') AS DOUBLE) / 365.25"
AGED = f"ag AS (SELECT g.*, {bands('age', s.AGE_BANDS)} AS age_group FROM (SELECT l.*, coalesce(gender, 'Unknown') AS gender, " \
       f"coalesce(city, 'Unknown') AS city, {AGE} AS age FROM li l LEFT JOIN customers c ON l.customer_id = c.customer_id) g)"
add("u01_with_customers", "SELECT source_rowid, l.customer_id, name, city, country, job_title FROM li l LEFT JOIN customers c ON l.customer_id = c.customer_id")
add("u02_customer_summary", "SELECT * FROM cs")
SEGMENTED = (
    f"sg AS (SELECT *, {quartile_label('customer_revenue', s.CUSTOMER_SEGMENTS, 'edges')} AS customer_segment "
    f"FROM cs, (SELECT {quartiles('customer_revenue')} AS edges FROM cs))"
)
add("u03_customer_segment", "SELECT customer_id, customer_revenue, customer_segment FROM sg", SEGMENTED)
TYPED = "ty AS (SELECT l.*, cs.first_purchase, CASE WHEN transaction_date = cs.first_purchase THEN 'New' ELSE 'Returning' END AS customer_type " \
        "FROM li l LEFT JOIN cs ON l.customer_id = cs.customer_id)"
add("u04_customer_type", "SELECT source_rowid, customer_id, first_purchase, customer_type FROM ty", TYPED)
add("u05_demographics", "SELECT source_rowid, gender, city, age, age_group FROM ag", AGED)
add("u06_customer_overview", f"SELECT COUNT(*) AS customers, {rnd(mean('customer_revenue'), 2)} AS avg_revenue_per_customer FROM cs")
add("u07_segment_summary", f"""
SELECT customer_segment, COUNT(*) AS customers, {total0('customer_revenue')} AS revenue,
       {order_of('customer_segment', s.CUSTOMER_SEGMENTS)} AS customer_segment_ord
FROM sg GROUP BY customer_segment""", SEGMENTED)
add("u08_new_vs_returning", f"SELECT customer_type, {total('revenue')} AS revenue FROM ty GROUP BY customer_type", TYPED)
add("u09_revenue_by_age_group", f"""
SELECT age_group, {total('revenue')} AS revenue, {order_of('age_group', labels_of(s.AGE_BANDS))} AS age_group_ord
FROM ag WHERE age_group IS NOT NULL GROUP BY age_group""", AGED)
add("u10_top_customer_cities", f"SELECT city, {total('revenue')} AS revenue FROM ag GROUP BY city ORDER BY revenue DESC, city LIMIT 10", AGED)


def tier(value: str, q: int) -> str:
    rank = f"row_number() OVER (ORDER BY {value}, customer_id)"
    return f"CAST(greatest(1, (({rank} - 1) * {q} + (COUNT(*) OVER ()) - 2) // greatest((COUNT(*) OVER ()) - 1, 1)) AS INTEGER)"


RFM = f"""rb AS (SELECT customer_id, MAX(transaction_date) AS lp, COUNT(DISTINCT invoice_id) AS frequency, {total0('revenue')} AS monetary
           FROM lk GROUP BY customer_id),
rr AS (SELECT customer_id, CAST(date_diff('day', lp, (SELECT MAX(lp) FROM rb) + 1) AS INTEGER) AS recency, frequency, monetary FROM rb),
rs AS (SELECT *, 6 - {tier('recency', 5)} AS r_score, {tier('frequency', 5)} AS f_score, {tier('monetary', 5)} AS m_score FROM rr),
rfm AS (SELECT *, r_score + f_score + m_score AS rfm_score, r_score || '' || f_score || '' || m_score AS rfm_code,
  CASE WHEN r_score >= 4 THEN CASE WHEN f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN f_score >= 3 THEN 'Loyal Customers' ELSE 'New / Promising' END
       WHEN r_score <= 2 AND f_score >= 4 THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost' ELSE 'Need Attention' END AS rfm_segment
  FROM rs)"""
add("u11_rfm_scores", "SELECT customer_id, recency, frequency, monetary, r_score, f_score, m_score, rfm_score, rfm_code FROM rfm", RFM)
add("u12_rfm_segment", "SELECT customer_id, rfm_code, rfm_segment FROM rfm", RFM)
add("u13_rfm_segment_summary", f"""
SELECT rfm_segment, COUNT(*) AS customers, {mean('recency')} AS avg_recency, {mean('frequency')} AS avg_frequency,
       {total0('monetary')} AS revenue, {mean('rfm_score')} AS avg_rfm_score FROM rfm GROUP BY rfm_segment""", RFM)
add("u14_top_rfm_customers", "SELECT * FROM rfm ORDER BY rfm_score DESC, customer_id LIMIT 10", RFM)
COHORT = """pu AS (SELECT *, MIN(transaction_date) OVER (PARTITION BY customer_id) AS fp FROM lk WHERE revenue > 0),
ci AS (SELECT *, strftime(transaction_date, '%Y-%m') AS order_month, strftime(fp, '%Y-%m') AS cohort_month,
  CAST(date_diff('month', date_trunc('month', fp), date_trunc('month', transaction_date)) + 1 AS INTEGER) AS cohort_index FROM pu),
cc AS (SELECT cohort_month, cohort_index, COUNT(DISTINCT customer_id) AS customers FROM ci GROUP BY ALL),
cr AS (SELECT a.*, b.customers AS cohort_size, """ + rnd(ratio("a.customers", "b.customers"), 4) + """ AS retention
  FROM cc a JOIN cc b ON a.cohort_month = b.cohort_month AND b.cohort_index = 1)"""
add("u15_cohort_index", "SELECT source_rowid, customer_id, order_month, cohort_month, cohort_index FROM ci", COHORT)
add("u16_cohort_retention", "SELECT * FROM cr", COHORT)
MONTH_COLUMNS = ", ".join(f"COALESCE(MAX(CASE WHEN cohort_index = {i} THEN retention END), 0.0) AS m{i:02d}" for i in range(1, s.MONTHS + 1))
add("u16_cohort_matrix", f"SELECT cohort_month, {MONTH_COLUMNS} FROM cr GROUP BY cohort_month", COHORT)
CLV = f"""cv AS (SELECT *, CAST(date_diff('day', first_purchase, last_purchase) AS INTEGER) AS customer_lifespan_days,
  CAST(greatest(date_diff('day', first_purchase, (SELECT MAX(last_purchase) FROM ck) + 1), 30) AS INTEGER) AS observed_customer_days FROM ck),
cw AS (SELECT *, customer_revenue / (CAST(observed_customer_days AS DOUBLE) / 365.25) AS annualized_clv, customer_revenue AS historical_clv FROM cv),
ct AS (SELECT *, {tier('historical_clv', 4)} AS clv_tier_ord FROM cw),
cl AS (SELECT *, ['Low CLV', 'Mid CLV', 'High CLV', 'VIP CLV'][clv_tier_ord] AS clv_tier FROM ct)"""
add("u17_customer_value", "SELECT customer_id, customer_revenue, customer_lifespan_days, observed_customer_days, annualized_clv FROM cw", CLV)
CLV_MEASURES = (
    ("avg_clv", "historical_clv"), ("avg_orders", "customer_orders"), ("avg_aov", '"customer_AOV"'),
    ("avg_lifespan_days", "customer_lifespan_days"), ("avg_observed_days", "observed_customer_days"), ("avg_annualized_clv", "annualized_clv"),
)
add("u18_clv_tier_summary", f"""
SELECT clv_tier, clv_tier_ord, COUNT(*) AS customers, {total0('historical_clv')} AS revenue,
       {', '.join(f'{mean(c)} AS {n}' for n, c in CLV_MEASURES)} FROM cl GROUP BY clv_tier, clv_tier_ord""", CLV)
add("u18_clv_tiers", "SELECT customer_id, historical_clv, clv_tier FROM cl", CLV)
add("u19_clv_overview", f"""
SELECT {ratio('r', 'o')} AS average_order_value, {ratio('o', 'c')} AS purchase_frequency, {ratio('r', 'c')} AS historical_clv, avg_lifespan_days
FROM (SELECT {total('customer_revenue')} AS r, SUM(customer_orders) AS o, COUNT(*) AS c, {mean('customer_lifespan_days')} AS avg_lifespan_days FROM cv)""", CLV)
add("u20_top_clv_customers", "SELECT * FROM cl ORDER BY historical_clv DESC, customer_id LIMIT 10", CLV)

# ---- products ----
PK = "product_id, product_name, category, sub_category"


def margin(t=""):
    return f"{ratio(total0('gross_profit'), total0('revenue'))} AS profit_margin"


def units(name, col):
    return f"{bigint(f'COALESCE(SUM({col}), 0)')} AS {name}"


RETURN_RATE = f"{ratio('SUM(units_returned)', '(SUM(units_sold) + SUM(units_returned))')} AS return_rate"
MONEY2 = f"{total0('revenue')} AS revenue, {total0('gross_profit')} AS gross_profit"
QTY, SOLD, BACK = units("quantity", "signed_quantity"), units("units_sold", "units_sold"), units("units_returned", "units_returned")
ORDERS = "COUNT(DISTINCT invoice_id) AS orders"
PS = f"""ps AS (SELECT {PK}, {MONEY2}, {total0('gross_sales')} AS gross_sales, {total0('cost_impact')} AS cost, {QTY}, {SOLD}, {BACK}, {ORDERS},
  {mean('unit_price')} AS avg_unit_price, {mean('discount')} AS avg_discount, {mean('production_cost')} AS production_cost,
  COUNT(*) FILTER (WHERE is_return) AS return_rows, {margin()}, {RETURN_RATE} FROM pk GROUP BY {PK})"""


def excluded(table, cond):
    return f"""SELECT COUNT(*) FILTER (WHERE {cond}) AS excluded_rows, {total0(f'CASE WHEN {cond} THEN revenue END')} AS excluded_revenue,
       COUNT(*) FILTER (WHERE NOT ({cond})) AS kept_rows, {total0(f'CASE WHEN NOT ({cond}) THEN revenue END')} AS kept_revenue FROM {table}"""


UNK_P = "(upper(product_id) = 'UNKNOWN_PRODUCT' OR category = 'Unknown')"
UNK_S = "(store_name = 'Unknown Store' OR country = 'Unknown')"
add("p01_product_lines", "SELECT source_rowid, product_id, category, sub_category, product_name, product_master_color, available_sizes, production_cost FROM pl")
add("p02_profit_measures", "SELECT source_rowid, signed_quantity, units_sold, units_returned, cost_impact, gross_profit, profit_margin FROM pl")
add("p03_unknown_product_split", excluded("pl", UNK_P))
add("p04_product_summary", "SELECT * FROM ps", PS)
add("p05_product_overview", f"""
SELECT *, COALESCE({ratio('gross_profit', 'revenue')}, 0.0) AS gross_margin FROM (
  SELECT COUNT(DISTINCT product_id) FILTER (WHERE NOT {UNK_P}) AS active_products,
         COUNT(DISTINCT product_id) FILTER (WHERE product_name = 'Unknown Product') AS products_missing_master,
         COUNT(*) FILTER (WHERE {UNK_P}) AS unknown_product_rows, {total0(f'CASE WHEN {UNK_P} THEN revenue END')} AS unknown_product_revenue,
         {total0(f'CASE WHEN NOT {UNK_P} THEN revenue END')} AS revenue, {total0(f'CASE WHEN NOT {UNK_P} THEN gross_profit END')} AS gross_profit,
         {bigint(f'COALESCE(SUM(CASE WHEN NOT {UNK_P} THEN units_sold END), 0)')} AS units_sold FROM pl)""")
add("p06_top_products_by_revenue", f"SELECT {PK}, revenue, quantity, gross_profit, profit_margin FROM ps ORDER BY revenue DESC, {PK} LIMIT 10", PS)
add("p07_top_products_by_profit", f"SELECT {PK}, revenue, gross_profit, profit_margin FROM ps ORDER BY gross_profit DESC, {PK} LIMIT 10", PS)
add("p08_bottom_products_by_profit", f"SELECT {PK}, revenue, gross_profit, profit_margin, return_rate FROM ps ORDER BY gross_profit, {PK} LIMIT 10", PS)
add("p09_category_performance", f"""
SELECT category, {MONEY2}, {QTY}, {SOLD}, {BACK}, {ORDERS}, COUNT(DISTINCT product_id) AS products, {mean('discount')} AS avg_discount, {margin()}, {RETURN_RATE}
FROM pk GROUP BY category""")
add("p10_top_sub_categories", f"""
SELECT category, sub_category, {MONEY2}, {QTY}, {ORDERS}, COUNT(DISTINCT product_id) AS products, {margin()}
FROM pk GROUP BY category, sub_category ORDER BY revenue DESC, category, sub_category LIMIT 15""")
add("p11_top_returned_products", f"""
SELECT {PK}, units_sold, units_returned, return_rate, revenue FROM ps WHERE units_returned > 0 ORDER BY return_rate DESC NULLS LAST, {PK} LIMIT 10""", PS)
add("p12_discount_by_category", f"SELECT category, {mean('discount')} AS avg_discount, {MONEY2}, {margin()} FROM pk GROUP BY category")
add("p13_top_colors", f"SELECT color, {MONEY2}, {QTY} FROM pk GROUP BY color ORDER BY revenue DESC, color LIMIT 10")
add("p14_size_performance", f"SELECT size, {MONEY2}, {QTY} FROM pk GROUP BY size")
ABC = PS + f""",
ar AS (SELECT {PK}, revenue, gross_profit, profit_margin, (SELECT {total('revenue')} FROM ps) AS t,
  CAST(SUM(CAST(revenue AS DECIMAL(20,6))) OVER (ORDER BY revenue DESC, {PK}) AS DOUBLE) AS cum FROM ps),
ab AS (SELECT {PK}, revenue, gross_profit, profit_margin, {ratio('revenue', 't')} AS revenue_share,
  {ratio('cum', 't')} AS cumulative_revenue_share, {bands(ratio('cum', 't'), s.ABC_BANDS, include_lowest=True)} AS abc_class FROM ar)"""
add("p15_abc_classes", "SELECT * FROM ab", ABC)
add("p16_abc_summary", f"""
SELECT abc_class, COUNT(DISTINCT product_id) AS products, {MONEY2}, {mean('profit_margin')} AS avg_margin,
       {ratio(total0('revenue'), f"(SELECT {total('revenue')} FROM ps)")} AS revenue_share
FROM ab WHERE abc_class IS NOT NULL GROUP BY abc_class""", ABC)
add("p17_monthly_top_categories", f"""
SELECT month, category, {total('revenue')} AS revenue FROM pk
WHERE category IN (SELECT category FROM pk GROUP BY category ORDER BY SUM(CAST(revenue AS DECIMAL(20,6))) DESC, category LIMIT 5)
GROUP BY month, category""")

# ---- stores ----
SK = "store_id, store_name, country, city"
AOV = f"{ratio(total0('revenue'), 'COUNT(DISTINCT invoice_id)')} AS aov"
SS = f"""ss AS (SELECT *, {ratio('revenue', 'number_of_employees')} AS revenue_per_employee,
    {ratio('gross_profit', 'number_of_employees')} AS profit_per_employee, {ratio('orders', 'number_of_employees')} AS orders_per_employee
  FROM (SELECT {SK}, number_of_employees, {MONEY2}, {QTY}, {SOLD}, {BACK}, {ORDERS}, COUNT(DISTINCT customer_id) AS customers,
    COUNT(DISTINCT product_id) AS products, {mean('discount')} AS avg_discount, COUNT(*) FILTER (WHERE is_return) AS return_rows,
    {AOV}, {margin()}, {RETURN_RATE} FROM sk GROUP BY {SK}, number_of_employees))"""
add("t01_store_lines", "SELECT source_rowid, store_id, store_name, country, city, zip_code, number_of_employees FROM sl")
add("t02_unknown_store_split", excluded("sl", UNK_S))
add("t03_store_summary", "SELECT * FROM ss", SS)
add("t04_store_overview", f"""
SELECT *, COALESCE({ratio('gross_profit', 'revenue')}, 0.0) AS gross_margin, COALESCE({ratio('revenue', 'active_stores')}, 0.0) AS avg_revenue_per_store
FROM (SELECT COUNT(DISTINCT store_id) AS active_stores, {bigint('SUM(orders)')} AS orders, {total0('revenue')} AS revenue, {total0('gross_profit')} AS gross_profit FROM ss),
     (SELECT COUNT(*) FILTER (WHERE {UNK_S}) AS unknown_store_rows, {total0(f'CASE WHEN {UNK_S} THEN revenue END')} AS unknown_store_revenue FROM sl)""", SS)
RV = f"SELECT {SK}, revenue, orders, gross_profit, profit_margin, aov FROM ss"
add("t05_top_stores", f"{RV} ORDER BY revenue DESC, {SK} LIMIT 10", SS)
add("t06_bottom_stores", f"{RV} ORDER BY revenue, {SK} LIMIT 10", SS)
add("t07_top_stores_per_employee", f"""
SELECT {SK}, number_of_employees, revenue, revenue_per_employee, profit_per_employee, orders_per_employee
FROM ss ORDER BY revenue_per_employee DESC NULLS LAST, {SK} LIMIT 10""", SS)
PLACE = f"COUNT(DISTINCT store_id) AS stores, {MONEY2}, {ORDERS}, COUNT(DISTINCT customer_id) AS customers, {SOLD}, {BACK}, {margin()}, {RETURN_RATE}"
add("t08_country_performance", f"SELECT country, {PLACE}, {mean('discount')} AS avg_discount, {AOV} FROM sk GROUP BY country")
add("t09_top_store_cities", f"SELECT country, city, {PLACE} FROM sk GROUP BY country, city ORDER BY revenue DESC, country, city LIMIT 15")
add("t10_highest_return_rates", f"SELECT {SK}, units_sold, units_returned, return_rate, revenue FROM ss ORDER BY return_rate DESC NULLS LAST, {SK} LIMIT 10", SS)
add("t11_highest_discounts", f"SELECT {SK}, avg_discount, revenue, gross_profit, profit_margin FROM ss ORDER BY avg_discount DESC NULLS LAST, {SK} LIMIT 10", SS)
add("t12_top_category_by_store", f"""
SELECT {SK}, category, {MONEY2}, {QTY} FROM sk GROUP BY {SK}, category
QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY SUM(CAST(revenue AS DECIMAL(20,6))) DESC, store_name, country, city, category) = 1""")
add("t13_country_category_mix", f"SELECT country, category, {MONEY2}, {QTY} FROM sk GROUP BY country, category")
add("t14_monthly_top_stores", f"""
SELECT month, store_name, {total('revenue')} AS revenue FROM sk
WHERE store_name IN (SELECT store_name FROM ss ORDER BY revenue DESC, {SK} LIMIT 5) GROUP BY month, store_name""", SS)
EMP = bands("number_of_employees", s.EMPLOYEE_BANDS, include_lowest=True)
add("t15_productivity_by_employee_band", f"""
SELECT employee_band, COUNT(DISTINCT store_id) AS stores, {total0('revenue')} AS revenue, {mean('revenue_per_employee')} AS avg_revenue_per_employee,
       {mean('profit_per_employee')} AS avg_profit_per_employee, {order_of('employee_band', labels_of(s.EMPLOYEE_BANDS))} AS employee_band_ord
FROM (SELECT *, {EMP} AS employee_band FROM ss) GROUP BY employee_band""", SS)

# ---- discounts ----
add("k01_campaigns", "SELECT * FROM active")
add("k02_campaign_assignment", "SELECT source_rowid, campaign_description, campaign_discount, is_campaign_period FROM dl")
O["k03_discount_status"] = "WITH " + ",".join([BINDING, FACT, DIMENSIONS]) + """,
x AS (
  SELECT source_rowid, transaction_date AS d, f.discount, coalesce(p.category, 'Unknown') AS category, coalesce(p.sub_category, 'Unknown') AS sub_category
  FROM fact f LEFT JOIN products p USING (product_id)
  WHERE transaction_date IS NOT NULL AND invoice_id IS NOT NULL AND unit_price IS NOT NULL AND quantity IS NOT NULL
    AND f.discount IS NOT NULL AND line_total IS NOT NULL),
offers AS (
  SELECT campaign_seq, TRY_CAST("start" AS TIMESTAMP) AS b, TRY_CAST("end" AS TIMESTAMP) AS e, TRY_CAST(discount AS DOUBLE) AS rate, category, sub_category
  FROM discounts),
best AS (
  SELECT source_rowid, max_by(rate, campaign_seq) AS rate FROM x JOIN offers USING (category, sub_category)
  WHERE d >= b AND d <= e AND rate IS NOT NULL GROUP BY source_rowid)
SELECT source_rowid, discount > 0 AS has_discount, discount - coalesce(rate, 0.0) AS discount_gap,
       CASE WHEN rate IS NOT NULL AND discount > 0 THEN 'Campaign Discount'
            WHEN rate IS NOT NULL THEN 'Campaign Listed / No Discount Applied'
            WHEN discount > 0 THEN 'Non-Campaign Discount' ELSE 'No Discount' END AS discount_status
FROM x LEFT JOIN best USING (source_rowid)"""
add("k04_discount_overview", f"""
SELECT {total0('revenue')} AS total_revenue, {total0('gross_profit')} AS total_profit,
       {', '.join(f"{total0(f'CASE WHEN {c} THEN revenue END')} AS {n}" for c, n in (
           ('has_discount', 'discounted_revenue'), ('NOT has_discount', 'no_discount_revenue'),
           ('is_campaign_period', 'campaign_revenue'), ('NOT is_campaign_period', 'non_campaign_revenue')))},
       COUNT(*) FILTER (WHERE is_campaign_period) AS campaign_rows, COUNT(*) FILTER (WHERE has_discount) AS discounted_rows FROM dl""")


def core(name):
    rate = ratio("COUNT(*) FILTER (WHERE is_return)", "COUNT(*)")
    return f"""COUNT(*) AS rows, {ORDERS}, {MONEY2}, {QTY}, {mean('discount')} AS {name}, COUNT(*) FILTER (WHERE is_return) AS return_rows,
       {margin()}, {rate} AS return_row_rate"""


GAP = f"{mean('discount')} - {mean('campaign_discount')} AS discount_gap"
add("k05_discount_status_summary", f"SELECT discount_status, {core('avg_discount')}, {mean('campaign_discount')} AS avg_campaign_discount FROM dl GROUP BY discount_status")
add("k06_discount_group_summary", f"SELECT discount_group, {core('avg_discount')}, {order_of('discount_group', labels_of(s.DISCOUNT_BANDS))} AS discount_group_ord FROM dl GROUP BY discount_group")
K7 = f"SELECT campaign_description, {core('avg_actual_discount')}, {mean('campaign_discount')} AS campaign_discount, {GAP} FROM dl WHERE is_campaign_period GROUP BY campaign_description"
add("k07_campaign_summary", K7)
add("k08_category_by_status", f"SELECT category, discount_status, {MONEY2}, {QTY}, {ORDERS}, {mean('discount')} AS avg_discount, {margin()} FROM dl GROUP BY ALL")
CK = "campaign_description, category, sub_category"
add("k09_top_campaign_categories", f"""
SELECT {CK}, {MONEY2}, {QTY}, {ORDERS}, {mean('discount')} AS avg_actual_discount, {mean('campaign_discount')} AS campaign_discount, {margin()}, {GAP}
FROM dl WHERE is_campaign_period GROUP BY {CK} ORDER BY revenue DESC, {CK} LIMIT 20""")
add("k10_monthly_status_trend", f"SELECT month, discount_status, {MONEY2}, {ORDERS} FROM dl GROUP BY month, discount_status")
KC = ("discount", "campaign_discount", "revenue", "gross_profit", "quantity")
add("k11_discount_correlation", correlations("mat", KC), ONCE.format(cols=", ".join(KC), table="dl"))
add("k12_high_discount_low_margin", f"""
SELECT * FROM (SELECT {PK}, {MONEY2}, {QTY}, {mean('discount')} AS avg_discount, {ORDERS}, {margin()} FROM dl WHERE has_discount GROUP BY {PK})
WHERE avg_discount >= 0.3 AND profit_margin < 0.4 ORDER BY avg_discount DESC, profit_margin, {PK} LIMIT 20""")

# ---- figures named in prose ----
add("r01_new_customers", "SELECT month, COUNT(*) AS new_customers FROM (SELECT customer_id, MIN(month) AS month FROM lk GROUP BY customer_id) GROUP BY month")
add("r02_repeat_rate", f"""
SELECT *, {ratio('repeat_customers', 'customers')} AS repeat_rate
FROM (SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE customer_orders >= 2) AS repeat_customers FROM ck)""")
add("r03_customers_by_place", f"""
SELECT coalesce(country, 'Unknown') AS country, coalesce(city, 'Unknown') AS city, COUNT(*) AS customers, {total('customer_revenue')} AS revenue
FROM ck LEFT JOIN customers USING (customer_id) GROUP BY 1, 2""")
add("r04_profitable_products", """SELECT COUNT(*) FILTER (WHERE gross_profit < 0) AS loss_making_products,
  COUNT(*) FILTER (WHERE gross_profit > 0) AS profitable_products, COUNT(*) FILTER (WHERE gross_profit = 0) AS break_even_products FROM ps""", PS)
add("r05_revenue_contribution", "SELECT product_id, product_name, abc_class, revenue, revenue_share FROM ab", ABC)
add("r06_demand_by_hour", f"""
SELECT CAST(hour(CAST(transaction_datetime AS TIMESTAMP)) AS INTEGER) AS hour, {ORDERS}, {total0('revenue')} AS revenue FROM li GROUP BY 1""")
add("r07_store_matrix", f"""
SELECT {SK}, revenue, profit_margin, CASE WHEN revenue > (SELECT quantile_cont(revenue, 0.5) FROM ss) THEN 'High' ELSE 'Low' END AS revenue_side,
       CASE WHEN profit_margin > (SELECT quantile_cont(profit_margin, 0.5) FROM ss) THEN 'High' ELSE 'Low' END AS margin_side,
       revenue = (SELECT MAX(revenue) FROM ss) AS is_best FROM ss""", SS)
add("r08_discount_share", f"""
SELECT *, {ratio('discounted_revenue', 'revenue')} AS discount_share, {ratio('discount_amount', 'gross_sales')} AS effective_discount_rate
FROM (SELECT {total0('CASE WHEN discount > 0 THEN revenue END')} AS discounted_revenue, {total0('revenue')} AS revenue,
             {total0('discount_amount')} AS discount_amount, {total0('gross_sales')} AS gross_sales FROM li)""")
add("r09_campaign_matrix", """
SELECT campaign_description, orders, revenue, gross_profit, profit_margin,
       revenue = MAX(revenue) OVER () AS is_best_revenue, gross_profit = MAX(gross_profit) OVER () AS is_best_profit FROM k7""", f"k7 AS ({K7})")
add("r10_campaign_roi", f"""
SELECT *, {ratio('gross_profit', 'discount_amount')} - 1 AS roi
FROM (SELECT campaign_description, {total0('gross_profit')} AS gross_profit, {total0('discount_amount')} AS discount_amount
      FROM dl WHERE is_campaign_period GROUP BY campaign_description)""")
add("r11_campaign_payback", """
SELECT campaign_description, MIN(transaction_date) AS first_day, MIN(CASE WHEN cum >= tot THEN transaction_date END) AS payback_day,
       CAST(MAX(tot) AS DOUBLE) AS discount_amount, CAST(SUM(gp) AS DOUBLE) AS gross_profit,
       CAST(date_diff('day', MIN(transaction_date), MIN(CASE WHEN cum >= tot THEN transaction_date END)) AS INTEGER) AS days_to_payback
FROM (SELECT *, SUM(gp) OVER (PARTITION BY campaign_description ORDER BY transaction_date) AS cum,
             SUM(da) OVER (PARTITION BY campaign_description) AS tot
      FROM (SELECT campaign_description, transaction_date, SUM(CAST(gross_profit AS DECIMAL(20,6))) AS gp, SUM(CAST(discount_amount AS DECIMAL(20,6))) AS da
            FROM dl WHERE is_campaign_period GROUP BY campaign_description, transaction_date))
GROUP BY campaign_description""")

ANALYTICS = O
