"""Cleaning and imputation of raw transactions into a conformed star schema.

Most lines are complete and stay in one narrow scan. Incomplete lines are exchanged only to meet what they lack:
those that lack what their invoice can tell move to it, those that lack a value of their product move to that, and the few
left without a customer or a store move once more, to their sale and their employee.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tillsight import schema as s
from tillsight.functions.members import MANY, among, key_words, likely
from tillsight.functions.ranking import row_numbers
from tillsight.functions.semantics import (
    money, parsed, percent, round_half_up, tally, to_day, total, total_or_zero, typed,
)
from tillsight.functions.skew import join_back
from tillsight.session import stage_lines as stage
from tillsight.sources.tables import Dimensions

RENAMED = {"date": "transaction_datetime"}
ATTRIBUTES = s.INVOICE_ATTRIBUTES


# ---- normalise, split, audit ------------------------------------------------

def normalise(raw: DataFrame) -> DataFrame:
    """Typed columns with placeholders as NULL; each raw value is trimmed and parsed once."""
    return typed(parsed(raw, s.RAW_COLUMNS), s.RAW_COLUMNS).withColumnsRenamed(RENAMED)


def with_day(lines: DataFrame) -> DataFrame:
    return lines.withColumn("transaction_date", to_day(F.col("transaction_datetime")))


def normalised_view(raw: DataFrame) -> DataFrame:
    """Normalised lines with their day, default currency and critical-issue flag."""
    lines = with_day(normalise(raw)).withColumns({
        "currency": F.coalesce("currency", F.lit(s.DEFAULT_CURRENCY)),
        "currency_symbol": F.coalesce("currency_symbol", F.lit(s.DEFAULT_SYMBOL)),
    })
    missing = F.lit(False)
    for column in s.CRITICAL_COLUMNS:
        missing = missing | F.col(column).isNull()
    return lines.withColumn("has_critical_issue", missing.cast("int"))


def line_amount(price: Column, quantity: Column, discount: Column) -> Column:
    return price * quantity * (1 - discount)


def clean_rows(raw: DataFrame) -> DataFrame:
    """Lines without critical issues; missing totals are computed, missing customers named."""
    rate = F.coalesce("discount", F.lit(0.0))
    amount = F.coalesce(F.col("line_total"), line_amount(F.col("unit_price"), F.col("quantity"), rate))
    return normalised_view(raw).filter(F.col("has_critical_issue") == 0).withColumns({
        "customer_id": F.coalesce("customer_id", F.lit(s.UNKNOWN_CUSTOMER)),
        "line_total": money(amount),
    }).drop("has_critical_issue")


def rejected_rows(raw: DataFrame) -> DataFrame:
    return normalised_view(raw).filter(F.col("has_critical_issue") == 1)


def orphan_keys(lines: DataFrame, dims: Dimensions) -> DataFrame:
    """Key values without a master row, and how many lines carry each.

    The four keys are stacked and counted in one pass; only distinct key values meet
    the masters.
    """
    masters = {"customer_id": dims.customers, "product_id": dims.products, "store_id": dims.stores, "employee_id": dims.employees}
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("invalid_value")) for k in masters])
    used = lines.select(F.inline(cells)).filter(F.col("invalid_value").isNotNull())
    counted = used.groupBy("field", "invalid_value").agg(F.count("*").alias("cnt"))
    known = None
    for key, master in masters.items():
        part = master.select(F.lit(key).alias("field"), F.col(key).cast("string").alias("invalid_value"))
        known = part if known is None else known.unionByName(part)
    return counted.join(known, ["field", "invalid_value"], "left_anti")


def drop_exact_duplicates(raw: DataFrame) -> DataFrame:
    """One line per distinct set of values, under its smallest row id; merges copies before shuffling."""
    columns = [c for c in raw.columns if c != "source_rowid"]
    return raw.groupBy(*columns).agg(F.min("source_rowid").alias("source_rowid"))


# ---- what other lines can tell ---------------------------------------------

def invoice_consensus(lines: DataFrame) -> DataFrame:
    """Per invoice, each attribute's value where all its lines that have one agree."""
    agreed = [F.when(F.min(c) == F.max(c), F.max(c)).alias(f"invoice_{c}") for c in ATTRIBUTES]
    return lines.filter(F.col("invoice_id").isNotNull()).groupBy("invoice_id").agg(*agreed)


def sale_histogram(lines: DataFrame) -> DataFrame:
    """Number of lines per product, price and quantity: all that the modes need, from one pass."""
    return lines.groupBy("product_id", "unit_price", "quantity").agg(F.count("*").alias("n"))


def _most_frequent(histogram: DataFrame, column: str, preference: Column) -> DataFrame:
    """Most frequent value per product; equal counts go to the larger ``preference``."""
    counts = histogram.filter(F.col("product_id").isNotNull() & F.col(column).isNotNull())
    counts = counts.groupBy("product_id", column).agg(F.sum("n").alias("n"))
    best = F.max(F.struct(F.col("n"), preference.alias("preference"), F.col(column).alias("value")))
    return counts.groupBy("product_id").agg(best.alias("best")).select("product_id", F.col("best.value").alias(column))


def price_modes(histogram: DataFrame) -> DataFrame:
    """Most frequent price per product, the higher one on a tie."""
    return _most_frequent(histogram, "unit_price", F.col("unit_price"))


def quantity_modes(histogram: DataFrame) -> DataFrame:
    """Most frequent positive quantity per product, the lower one on a tie."""
    return _most_frequent(histogram.filter(F.col("quantity") > 0), "quantity", -F.col("quantity"))


def product_modes(histogram: DataFrame) -> DataFrame:
    """Price and quantity mode of each product that has either, from one pass; a histogram dealt by product does not move again."""
    n, price, quantity = F.col("n"), F.col("unit_price"), F.col("quantity")
    known = F.when(quantity > 0, quantity)
    kinds = F.array(
        F.struct(price.alias("unit_price"), F.lit(None).cast("bigint").alias("quantity")),
        F.struct(F.lit(None).cast("double").alias("unit_price"), known.alias("quantity")),
    )
    cells = histogram.filter(F.col("product_id").isNotNull()).select("product_id", "n", F.inline(kinds))
    counts = cells.filter(price.isNotNull() | quantity.isNotNull()).groupBy("product_id", "unit_price", "quantity").agg(F.sum("n").alias("n"))

    def most(column: Column, preference: Column) -> Column:
        return F.max(F.when(column.isNotNull(), F.struct(n, preference.alias("preference"), column.alias("value")))).getField("value")

    return counts.groupBy("product_id").agg(
        most(price, price).alias("product_mode_unit_price"), most(quantity, -quantity).alias("product_mode_quantity")
    )


def common_quantity(histogram: DataFrame) -> DataFrame:
    """One row: the most frequent positive quantity overall, the lower one on a tie."""
    counts = histogram.filter(F.col("quantity") > 0).groupBy("quantity").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("quantity")).alias("preference"), F.col("quantity").alias("value")))
    return counts.agg(best.alias("best")).select(F.col("best.value").alias("quantity"))


def sku_digits(sku: Column) -> Column:
    """First run of digits in an SKU, NULL when it has none."""
    return F.nullif(F.regexp_extract(sku, "[0-9]+", 0), F.lit(""))


def sku_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Product read from the SKU of lines that lack one, where that product exists."""
    wanted = lines.filter(F.col("product_id").isNull() & F.col("sku").isNotNull())
    coded = wanted.select("source_rowid", "sku", sku_digits(F.col("sku")).alias("product_id"))
    return coded.join(products.select("product_id"), "product_id", "left_semi")


def sibling_invoice(invoice: Column) -> Column:
    """The sale invoice a return invoice refers to."""
    sale = F.concat(F.lit(s.SALE_PREFIX), F.substr(invoice, F.lit(len(s.RETURN_PREFIX) + 1)))
    return F.when(invoice.ilike(s.RETURN_PREFIX + "%"), sale)


def sale_customers(consensus: DataFrame) -> DataFrame:
    """The one customer of each sale that has just one."""
    sales = consensus.select(F.col("invoice_id").alias("sale_id"), F.col("invoice_customer_id").alias("sale_customer_id"))
    return sales.filter(F.col("sale_customer_id").isNotNull())


def return_customers(lines: DataFrame) -> DataFrame:
    """Customer of the matching sale, per return invoice, where that sale has just one."""
    returns = lines.select("invoice_id").distinct().withColumn("sale_id", sibling_invoice(F.col("invoice_id")))
    return returns.join(sale_customers(invoice_consensus(lines)), "sale_id").select("invoice_id", "sale_customer_id")


def line_numbers(lines: DataFrame) -> DataFrame:
    """Position of each line in its invoice, by row id."""
    keyed = lines.filter(F.col("invoice_id").isNotNull()).select("invoice_id", "source_rowid")
    return row_numbers(keyed, "invoice_id", "source_rowid").withColumnRenamed("row_number", "invoice_row_number")


# ---- imputation -------------------------------------------------------------

def unfilled(columns: tuple[str, ...]) -> Column:
    missing = F.lit(False)
    for column in columns:
        missing = missing | F.col(column).isNull()
    return missing


NEEDED = ("line_no", "product_id", "color", "unit_price", "quantity", *ATTRIBUTES)
FORMULAS = ("unit_price_from_formula", "quantity_from_formula", "discount_from_formula")
OF_PRODUCT = ("product_id", "color", "unit_price", "quantity")
BLANK = {"product_mode_unit_price": "double", "product_mode_quantity": "bigint", "global_mode_quantity": "bigint"}


def blanks() -> dict[str, Column]:
    """The modes of lines that need none."""
    return {name: F.lit(None).cast(kind) for name, kind in BLANK.items()}


def asks_invoice() -> Column:
    """Whether a line lacks what only its invoice can tell: a number, an attribute, or an amount that its own values do not give."""
    open_amount = F.col("line_total").isNull() & (F.col("unit_price").isNull() | F.col("quantity").isNull())
    return unfilled(("line_no", *ATTRIBUTES)) | open_amount


def _asked(keyed: DataFrame) -> DataFrame:
    """Lines that ask their invoice; those without a customer come again, empty, to ask the sale they return (``is_sale``)."""
    sale = F.when(F.col("customer_id").isNull(), sibling_invoice(F.col("invoice_id")))
    roles = F.when(sale.isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    asking = keyed.filter(asks_invoice()).withColumn("is_sale", F.explode(roles))
    own = {c: F.when(~F.col("is_sale"), F.col(c)) for c in keyed.columns}
    return asking.withColumns(own | {"invoice_id": F.when(F.col("is_sale"), sale).otherwise(F.col("invoice_id"))})


def _families(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """Lines that ask their invoice, and the sales asked, with the attributes the invoice agrees on.

    Only these lines are exchanged whole, once; of others only what an invoice agrees on moves, and little of that where no
    line asks (``asked`` are the ``key_words`` of the invoices asked).
    """
    rows = _asked(keyed).join(invoice_consensus(likely(keyed, "invoice_id", asked, MANY)), "invoice_id", "left")
    return rows.withColumns({c: F.coalesce(c, f"invoice_{c}") for c in ATTRIBUTES}).select(*keyed.columns, "is_sale")


def _asked_sales(family: DataFrame) -> DataFrame:
    """The one customer of each sale that was asked for and has just one."""
    found = family.filter(F.col("is_sale") & F.col("customer_id").isNotNull())
    return found.groupBy(F.col("invoice_id").alias("sale_id")).agg(F.max("customer_id").alias("sale_customer_id"))


def _line_positions(keyed: DataFrame) -> DataFrame:
    """Position in its invoice of each line without a number, by row id."""
    unnumbered = keyed.filter(F.col("line_no").isNull())
    concerned = among(keyed.select("invoice_id", "source_rowid"), "invoice_id", unnumbered.select("invoice_id"))
    return line_numbers(concerned).join(unnumbered.select("source_rowid"), "source_rowid", "left_semi").select("source_rowid", "invoice_row_number")


def _one_per_key(master: DataFrame, key: str, value: str) -> DataFrame:
    """Master rows reduced to one per key, the smallest value of repeated ones."""
    return master.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.min(value).alias(value))


def _product_values(lines: DataFrame, dims: Dimensions) -> DataFrame:
    """What is known of each product: its master and the modes of its lines, which are exchanged once, in three columns."""
    dealt = lines.select("product_id", "unit_price", "quantity").filter(F.col("product_id").isNotNull()).repartition("product_id")
    masters = _one_per_key(dims.products, "product_id", "color").select(
        "product_id", F.col("product_id").alias("master_id"), F.col("color").alias("master_color")
    )
    return masters.join(product_modes(sale_histogram(dealt)), "product_id", "full").withColumnRenamed("product_id", "lookup_id")


def _where(rows: DataFrame, needed: Column, fill) -> DataFrame:
    """``fill`` of the rows that need it; only these are exchanged."""
    return fill(rows.filter(needed)).unionByName(rows.filter(~needed))


def _from_product(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Product by SKU, colour and modes of rows that lack a product, a colour, a price or a quantity."""
    coded = F.when(F.col("product_id").isNull(), sku_digits(F.col("sku")))
    found = join_back(rows.drop(*BLANK).withColumn("lookup_id", F.coalesce(F.col("product_id"), coded)), products, ["lookup_id"], spread="source_rowid")
    found = found.withColumn("product_id", F.coalesce("product_id", "master_id")).withColumns({
        "color": F.coalesce("color", "master_color"),
        **{c: F.when(F.col("product_id").isNotNull(), F.col(c)) for c in ("product_mode_unit_price", "product_mode_quantity")},
    })
    return found.withColumn("global_mode_quantity", F.lit(None).cast("bigint")).select(*rows.columns)


def _from_invoice(rows: DataFrame, positions: DataFrame, sales: DataFrame, dims: Dimensions) -> DataFrame:
    """Numbers, customers of returned sales and stores of employees, for rows that know their invoice's attributes."""
    def number(part: DataFrame) -> DataFrame:
        return join_back(part, positions, ["source_rowid"]).withColumn("line_no", F.coalesce("line_no", "invoice_row_number")).select(*rows.columns)

    def member(part: DataFrame) -> DataFrame:
        sale = F.when(F.col("customer_id").isNull(), sibling_invoice(F.col("invoice_id")))
        part = join_back(part.withColumn("sale_id", sale), sales, ["sale_id"], spread="source_rowid")
        staff = _one_per_key(dims.employees, "employee_id", "store_id").withColumnRenamed("store_id", "staff_store_id")
        part = join_back(part, staff, ["employee_id"], spread="source_rowid")
        return part.withColumns({
            "customer_id": F.coalesce("customer_id", "sale_customer_id"), "store_id": F.coalesce("store_id", "staff_store_id"),
        }).select(*rows.columns)

    nameless = F.col("customer_id").isNull() & sibling_invoice(F.col("invoice_id")).isNotNull()
    homeless = F.col("store_id").isNull() & F.col("employee_id").isNotNull()
    return _where(_where(rows, F.col("line_no").isNull(), number), nameless | homeless, member)


def _with_defaults(rows: DataFrame, usual: DataFrame) -> DataFrame:
    return rows.withColumns({
        "currency": F.coalesce("currency", F.lit(s.DEFAULT_CURRENCY)),
        "currency_symbol": F.coalesce("currency_symbol", F.lit(s.DEFAULT_SYMBOL)),
        "global_mode_quantity": usual.scalar(),
    })


def _fill_incomplete(lines: DataFrame, dims: Dimensions) -> DataFrame:
    """Incomplete lines, filled from their invoice, masters and product modes."""
    keyed = lines.filter(F.col("invoice_id").isNotNull())
    asked = stage(key_words(_asked(keyed), "invoice_id", MANY), "asked_invoices")
    family = stage(_families(keyed, asked), "invoice_families")
    sales = stage(_asked_sales(family), "invoice_consensus")
    # Modes learn from every line, also from those without an invoice, which the result drops.
    products = stage(_product_values(lines, dims), "sale_histogram")
    usual = stage(common_quantity(lines.groupBy("quantity").agg(F.count("*").alias("n"))), "common_quantity")
    positions = stage(_line_positions(keyed), "line_positions")
    asking = _from_invoice(family.filter(~F.col("is_sale")).drop("is_sale").withColumns(blanks()), positions, sales, dims)
    asking = _where(asking, unfilled(OF_PRODUCT), lambda part: _from_product(part, products))
    others = _from_product(keyed.filter(unfilled(NEEDED) & ~asks_invoice()).withColumns(blanks()), products)
    return stage(_with_defaults(asking, usual), "incomplete_lines").unionByName(stage(_with_defaults(others, usual), "lines_without_product_values"))


def derive_amounts(lines: DataFrame) -> DataFrame:
    """Price, quantity or discount solved from the line total where the other two are known."""
    price, quantity, rate, amount = (F.col(c) for c in ("unit_price", "quantity", "discount", "line_total"))
    paid = F.abs(amount)
    kept = 1 - rate
    quotient = F.try_divide(paid, price * kept)
    free = 1 - F.try_divide(paid, price * quantity)
    return lines.withColumns({
        "unit_price_from_formula": F.when(price.isNull(), money(F.try_divide(paid, quantity * kept))),
        "quantity_from_formula": F.when(quantity.isNull(), whole_number(quotient)),
        "discount_from_formula": F.when(rate.isNull() & free.between(0, 1), round_half_up(free, 4)),
    })


def whole_number(x: Column) -> Column:
    """``x`` as bigint when it is within tolerance of one, else NULL."""
    nearest = round_half_up(x, 0)
    return F.when(F.abs(x - nearest) < s.WHOLE_QUANTITY_TOLERANCE, nearest.try_cast("bigint"))


def settle_values(lines: DataFrame) -> DataFrame:
    """Best available price, quantity and discount, with defaults for descriptive columns."""
    return with_day(lines.withColumns({
        "size": F.coalesce("size", F.lit(s.UNKNOWN)),
        "color": F.coalesce("color", F.lit(s.NO_COLOR)),
        "unit_price": F.coalesce("unit_price", "unit_price_from_formula", "product_mode_unit_price"),
        "quantity": F.coalesce("quantity", "quantity_from_formula", "product_mode_quantity", "global_mode_quantity"),
        "discount": F.coalesce("discount", "discount_from_formula", F.lit(0.0)),
    }))


def settle_totals(lines: DataFrame) -> DataFrame:
    """Rounded line total; computed ones are negative for returns."""
    amount = line_amount(F.col("unit_price"), F.col("quantity"), F.col("discount"))
    signed = F.when(F.col("transaction_type") == "Return", -amount).otherwise(amount)
    return lines.withColumn("line_total", money(F.coalesce(F.col("line_total"), signed)))


def invoice_residuals(lines: DataFrame) -> DataFrame:
    """Per invoice: unknown lines, known sum, and the residual when one total explains one gap."""
    total = F.col("invoice_total")
    summary = lines.groupBy("invoice_id").agg(
        tally(F.col("line_total").isNull()).alias("missing_lines"),
        total_or_zero(F.col("line_total")).alias("known_sum"),
        F.count("line_total").alias("known_lines"),
        F.when(F.min(total) == F.max(total), F.max(total)).alias("agreed_total"),
    )
    gap = F.when(F.col("missing_lines") == 1, money(F.col("agreed_total") - F.col("known_sum")))
    closed = gap.isNotNull()
    computed = money(F.when(closed, F.col("known_sum") + gap).when(F.col("known_lines") > 0, F.col("known_sum")))
    return summary.withColumns({
        "residual": gap,
        "computed_invoice_total": F.when(closed | (F.col("missing_lines") == 0), computed),
    }).select("invoice_id", "residual", "computed_invoice_total")


def apply_residuals(lines: DataFrame, residuals: DataFrame) -> DataFrame:
    joined = join_back(lines, residuals, ["invoice_id"])
    residual = F.when(F.col("line_total").isNull(), F.col("residual"))
    solved = whole_number(F.try_divide(F.abs(residual), F.col("unit_price") * (1 - F.col("discount"))))
    return joined.withColumn("line_total_from_invoice_residual", residual).withColumns({
        "solved_quantity": solved,
        "invoice_total": F.coalesce("invoice_total", "computed_invoice_total"),
    }).drop("residual", "computed_invoice_total")


def settle(part: DataFrame) -> DataFrame:
    return settle_totals(settle_values(derive_amounts(part)))


@dataclass(frozen=True)
class Imputation:
    """Stages of the imputation, each a lazy table over the complete lines and the staged incomplete ones."""

    intact: DataFrame
    repaired: DataFrame

    def _whole(self, step) -> DataFrame:
        return step(self.intact).unionByName(step(self.repaired))

    @property
    def filled(self) -> DataFrame:
        """Own, invoice, master and sibling values."""
        return self._whole(lambda part: part)

    @property
    def derived(self) -> DataFrame:
        """Plus values solved from the line total."""
        return self._whole(derive_amounts)

    @property
    def settled(self) -> DataFrame:
        """Plus modes, defaults and line totals."""
        return self._whole(settle)

    @cached_property
    def residual(self) -> DataFrame:
        """Plus residual of the invoice total for single gaps; of other lines only the totals in invoices with an open line move."""
        nothing = {
            "line_total_from_invoice_residual": F.lit(None).cast("double"), "solved_quantity": F.lit(None).cast("bigint"),
        }
        done = settle(self.repaired)
        open_line = F.col("line_total").isNull() | F.col("invoice_total").isNull()
        waiting = done.filter(open_line)
        totals = self.settled.select("invoice_id", "line_total", "invoice_total")
        residuals = stage(invoice_residuals(among(totals, "invoice_id", waiting.select("invoice_id"))), "invoice_residuals")
        return settle(self.intact).withColumns(nothing).unionByName(
            done.filter(~open_line).withColumns(nothing)
        ).unionByName(apply_residuals(waiting, residuals))

    @property
    def imputed(self) -> DataFrame:
        """Rows that can be placed, with presence flags."""
        return _place(self.residual)


def impute(raw: DataFrame, dims: Dimensions, lines: DataFrame | None = None) -> Imputation:
    """Fill what can be filled; ``lines`` are the stored ``normalise(raw)``, where they exist already."""
    # Text is parsed once; the many column-pruned passes below read the typed copy.
    lines = stage(normalise(raw), "normalised_lines") if lines is None else lines
    intact = lines.filter(F.col("invoice_id").isNotNull() & ~unfilled(NEEDED)).withColumns(blanks())
    return Imputation(intact, _fill_incomplete(lines, dims))


def _place(lines: DataFrame) -> DataFrame:
    """Rows with invoice, moment and type; unknown keys named and presence flagged."""
    known = lines.filter(F.col("transaction_datetime").isNotNull() & F.col("transaction_type").isNotNull())
    flags = {f"has_{c}": F.col(c).isNotNull().cast("int") for c in ("line_no", "customer_id", "product_id", "unit_price")}
    flags["has_quantity"] = (F.col("quantity").isNotNull() | F.col("line_total_from_invoice_residual").isNotNull()).cast("int")
    unknown_staff = F.concat(F.lit(s.UNKNOWN_EMPLOYEE_PREFIX), F.coalesce("store_id", F.lit("UNKNOWN")))
    return known.withColumns(flags).withColumns({
        "customer_id": F.coalesce("customer_id", F.lit(s.UNKNOWN_CUSTOMER)),
        "quantity": F.coalesce("quantity", "solved_quantity"),
        "line_total": F.coalesce("line_total", "line_total_from_invoice_residual"),
        "employee_id": F.coalesce(F.col("employee_id"), unknown_staff),
        "sku": F.coalesce("sku", F.lit(s.NO_SKU)),
        "payment_method": F.coalesce("payment_method", F.lit(s.UNKNOWN)),
    }).select(*s.FINAL_COLUMNS)


def final_transactions(imputed: DataFrame) -> DataFrame:
    """Final fact table: unknown members named, amounts defaulted to 0, flags recomputed."""
    zero = F.lit(0.0)
    named = imputed.withColumns({
        "product_id": F.coalesce("product_id", F.lit(s.UNKNOWN_PRODUCT)),
        "store_id": F.coalesce("store_id", F.lit(s.UNKNOWN_STORE)),
        "unit_price": F.coalesce("unit_price", zero),
        "quantity": F.coalesce("quantity", F.lit(0).cast("bigint")),
        "line_total": F.coalesce("line_total", zero),
        "invoice_total": F.coalesce("invoice_total", zero),
    })
    return named.withColumns({
        "has_customer_id": (F.col("customer_id") != s.UNKNOWN_CUSTOMER).cast("int"),
        "has_product_id": (F.col("product_id") != s.UNKNOWN_PRODUCT).cast("int"),
        "has_unit_price": (F.col("unit_price") != 0).cast("int"),
        "has_quantity": (F.col("quantity") != 0).cast("int"),
    }).select(*s.FINAL_COLUMNS)


# ---- conformed dimensions ---------------------------------------------------

def _with_unknown(master: DataFrame, **values) -> DataFrame:
    """Append the unknown member: given values, ``Unknown`` for other text, else NULL."""
    kinds = dict(master.dtypes)
    member = master.sparkSession.range(1).select(*[
        F.lit(values.get(c, s.UNKNOWN if kinds[c] == "string" else None)).cast(kinds[c]).alias(c) for c in master.columns
    ])
    return master.unionByName(member)


def final_employees(employees: DataFrame, stores: DataFrame) -> DataFrame:
    """Employees, one placeholder per store, and one for the unknown store."""
    store = F.col("store_id")
    placeholders = stores.select(
        F.concat(F.lit(s.UNKNOWN_EMPLOYEE_PREFIX), store).alias("employee_id"),
        store,
        F.concat(F.lit("Unknown Employee - Store "), store).alias("name"),
        F.lit(s.UNKNOWN).alias("position"),
    )
    staff = employees.select("employee_id", "store_id", "name", "position").unionByName(placeholders)
    return _with_unknown(
        staff, employee_id=s.UNKNOWN_EMPLOYEE_PREFIX + "UNKNOWN", store_id=None, name="Unknown Employee - Unknown Store"
    )


def final_customers(customers: DataFrame) -> DataFrame:
    columns = ("customer_id", "name", "email", "telephone", "city", "country", "gender", "date_of_birth", "job_title")
    return _with_unknown(
        customers.select(*columns), customer_id=s.UNKNOWN_CUSTOMER, name="Unknown Customer", date_of_birth=None
    )


def final_products(products: DataFrame) -> DataFrame:
    filled = products.withColumns({
        "color": F.coalesce("color", F.lit(s.NO_COLOR)), "size": F.coalesce("size", F.lit(s.UNKNOWN)),
    })
    return _with_unknown(filled, product_id=s.UNKNOWN_PRODUCT, color=s.NO_COLOR, production_cost=None)


def final_stores(stores: DataFrame) -> DataFrame:
    return _with_unknown(
        stores, store_id=s.UNKNOWN_STORE, store_name="Unknown Store", number_of_employees=None, latitude=None, longitude=None
    )


def final_dimensions(dims: Dimensions) -> Dimensions:
    return Dimensions(
        customers=final_customers(dims.customers), products=final_products(dims.products),
        stores=final_stores(dims.stores), employees=final_employees(dims.employees, dims.stores), discounts=dims.discounts,
    )


# ---- reports ----------------------------------------------------------------

CORE = ("customer_id", "product_id", "unit_price", "quantity", "line_total", "invoice_total")
DIGEST = "row_digest"
BATCH = 4096  # copies of a line that are listed at a time


def row_digest(lines: DataFrame) -> Column:
    """128-bit digest of all business columns."""
    business = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in lines.columns if c not in ("source_rowid", DIGEST)]
    return F.unhex(F.md5(F.concat_ws("\x01", *business)))


def repeated_digests(lines: DataFrame) -> DataFrame:
    """The digest of each copy of a line beyond its first; of all lines only digests move, and none is written for a line without a copy."""
    # One more row, without a digest: Spark leaves an observation out where it finds that a shuffle has no rows.
    one = lines.sparkSession.range(1).select(F.lit(None).cast("binary").alias(DIGEST))
    digests = lines.select(row_digest(lines).alias(DIGEST)).unionByName(one)
    counts = digests.groupBy(DIGEST).agg((F.count("*") - 1).alias("copies")).filter(F.col("copies") > 0)
    # Many copies of one line are listed a batch at a time.
    batches = counts.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {BATCH}"))))
    listed = F.least(F.lit(BATCH), F.col("copies") - F.col("batch") * BATCH).cast("int")
    return batches.select(F.explode(F.array_repeat(F.col(DIGEST), listed)).alias(DIGEST))


@dataclass(frozen=True)
class Figures:
    """What one version of the table was found to hold while it was read or written, and the digests of its copies."""

    seen: Observation
    lines: DataFrame

    @cached_property
    def digests(self) -> DataFrame:
        return stage(repeated_digests(self.lines), "repeated_lines")

    def __getitem__(self, name: str):
        return self.seen.get[name]


def observed(lines: DataFrame, missing: dict[str, Column], kind: Column) -> tuple[DataFrame, Observation]:
    """``lines``, with rows, gaps in core fields and revenue counted by the action that reads them.

    The counts come with the tasks of the final stage, each of which is counted once, so nothing is scanned again for them.
    """
    amount = F.abs(F.col("line_total"))
    revenue = F.when(F.lower(F.trim(kind)) == "return", -amount).otherwise(amount)
    gaps = sum((F.when(missing[c], 1).otherwise(0) for c in CORE), F.lit(0))
    seen = Observation()
    figures = {"rows": F.count("*"), "gaps": F.coalesce(F.sum(gaps), F.lit(0)), "revenue": total(revenue)}
    return lines.observe(seen, *[column.alias(name) for name, column in figures.items()]), seen


def observed_final(final: DataFrame) -> tuple[DataFrame, Observation]:
    """Final lines, counted while they are written; members named unknown are gaps."""
    unknown = {"customer_id": s.UNKNOWN_CUSTOMER, "product_id": s.UNKNOWN_PRODUCT}
    gaps = {c: F.col(c) == unknown[c] if c in unknown else F.col(c).isNull() for c in CORE}
    return observed(final, gaps, F.col("transaction_type"))


def stored_lines(raw: DataFrame) -> tuple[DataFrame, Figures]:
    """Stored ``normalise(raw)`` and the figures of ``raw``, counted while that is written."""
    counted, seen = observed(normalise(raw), {c: F.col(c).isNull() for c in CORE}, F.col("transaction_type"))
    return stage(counted, "normalised_lines"), Figures(seen, raw)


KEYS = ("customer_id", "product_id", "store_id", "employee_id")


@dataclass(frozen=True)
class Cleaned:
    """The final table, a stored one or the plan of it, and the figures of both versions."""

    final: DataFrame
    before: Figures
    after: Figures
    stored: bool = True

    @cached_property
    def keys(self) -> DataFrame:
        """The keys of the final table; a planned table is counted while they are written."""
        return self.final.select(*KEYS) if self.stored else stage(self.after.lines.select(*KEYS), "final_keys")


def cleaned(raw: DataFrame, dims: Dimensions) -> Cleaned:
    """Clean ``raw``; figures are counted while lines are written, and of the final lines each report writes what it reads."""
    lines, before = stored_lines(raw)
    final = final_transactions(impute(raw, dims, lines).imputed)
    counted, seen = observed_final(final)
    return Cleaned(final, before, Figures(seen, counted), stored=False)


def cleaning_summary(result: Cleaned, dims: Dimensions) -> DataFrame:
    """Rows before and after, and final rows whose keys still have no master; only the keys are read back."""
    orphans = orphan_keys(result.keys, final_dimensions(dims)).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("value"))
    metrics = {"raw_rows": F.lit(result.before["rows"]).cast("long"), "final_rows": F.lit(result.after["rows"]).cast("long"), "invalid_foreign_key_rows": F.col("value")}
    cells = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in metrics.items()])
    return orphans.select(F.inline(cells))


def quality_figures(figures: Figures, stage_name: str) -> DataFrame:
    """Rows, missing share of core fields, exact copies and revenue of one version; only digests of copies are read back."""
    copies = figures.digests.agg(F.count(DIGEST).alias("duplicate_rows"))
    rows = figures["rows"]
    return copies.select(
        F.lit(stage_name).alias("stage"), F.lit(rows).cast("long").alias("rows"),
        percent(F.lit(figures["gaps"]), F.lit(rows * len(CORE))).alias("missing_core_pct"),
        "duplicate_rows", F.lit(figures["revenue"]).cast("double").alias("revenue"),
    )


def before_after(result: Cleaned) -> DataFrame:
    """Quality figures of the raw and the final table side by side."""
    return quality_figures(result.before, "before").unionByName(quality_figures(result.after, "after"))
