"""Fixed values of the retail model: column lists, placeholders, labels, band edges.

The placeholder literals, defaults, labels and edges below are fixed values that
the results must reproduce exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

TEXT_PLACEHOLDERS = ("", "N/A", "unknown")
ID_PLACEHOLDERS = ("", "-1", "unknown", "N/A")
NUMBER_PLACEHOLDERS = ("", "unknown")


@dataclass(frozen=True)
class RawColumn:
    name: str
    kind: str  # text | id | real | int | datetime
    label: str  # how the completeness report classifies the column
    meaning: str

    @property
    def numeric(self) -> bool:
        return self.kind in ("real", "int")

    @property
    def placeholders(self) -> tuple[str, ...]:
        if self.numeric:
            return NUMBER_PLACEHOLDERS
        return ID_PLACEHOLDERS if self.kind == "id" else TEXT_PLACEHOLDERS


# Raw column names, classes and business meanings.
RAW_COLUMNS = (
    RawColumn("invoice_id", "text", "identifier", "Invoice identifier; groups multiple product lines in one transaction"),
    RawColumn("line_no", "int", "numeric / identifier", "Line item number within an invoice"),
    RawColumn("customer_id", "id", "identifier", "Customer identifier"),
    RawColumn("product_id", "id", "identifier", "Product identifier"),
    RawColumn("size", "text", "categorical", "Purchased item size"),
    RawColumn("color", "text", "categorical", "Purchased item color"),
    RawColumn("unit_price", "real", "numeric", "Selling price per item unit"),
    RawColumn("quantity", "int", "numeric", "Number of items purchased or returned"),
    RawColumn("date", "datetime", "datetime", "Transaction date and time"),
    RawColumn("discount", "real", "numeric", "Discount rate applied to line item"),
    RawColumn("line_total", "real", "numeric", "Line-level amount after discount"),
    RawColumn("store_id", "id", "identifier", "Store identifier"),
    RawColumn("employee_id", "id", "identifier", "Employee identifier"),
    RawColumn("currency", "text", "categorical", "Transaction currency"),
    RawColumn("currency_symbol", "text", "categorical", "Currency symbol"),
    RawColumn("sku", "text", "identifier / text", "Stock keeping unit; may encode product, size, and color"),
    RawColumn("transaction_type", "text", "categorical", "Sale or Return"),
    RawColumn("payment_method", "text", "categorical", "Payment channel used"),
    RawColumn("invoice_total", "real", "numeric", "Invoice-level total amount"),
)
RAW = {c.name: c for c in RAW_COLUMNS}

# Columns whose placeholders are listed value by value.
PLACEHOLDER_REPORT = (
    "invoice_id", "customer_id", "product_id", "unit_price", "quantity", "line_total", "invoice_total",
)

# Attributes that should agree on all lines of one invoice.
INVOICE_ATTRIBUTES = (
    "customer_id", "transaction_datetime", "store_id", "employee_id", "currency",
    "currency_symbol", "transaction_type", "payment_method", "invoice_total",
)

CRITICAL_COLUMNS = ("invoice_id", "transaction_datetime", "unit_price", "quantity", "transaction_type")

# Defaults and unknown members.
DEFAULT_CURRENCY = "USD"
DEFAULT_SYMBOL = "$"
UNKNOWN = "Unknown"
UNKNOWN_CUSTOMER = "UNKNOWN_CUSTOMER"
UNKNOWN_PRODUCT = "UNKNOWN_PRODUCT"
UNKNOWN_STORE = "UNKNOWN_STORE"
UNKNOWN_EMPLOYEE_PREFIX = "UNKNOWN_STORE_"
NO_COLOR = "Not specified"
NO_SKU = "Not available"
SALE_PREFIX = "INV-"
RETURN_PREFIX = "RET-"

# Allowed domains.
TRANSACTION_TYPES = ("Sale", "Return")
PAYMENT_METHODS = ("Cash", "Credit Card")
CURRENCIES = ("USD",)
AMOUNT_TOLERANCE = 0.05
WHOLE_QUANTITY_TOLERANCE = 0.01

# Segment labels, lowest first.
PRICE_SEGMENTS = ("Low Price", "Mid Price", "High Price", "Premium Price")
ORDER_VALUE_GROUPS = ("Low Value", "Mid Value", "High Value", "Very High Value")
CUSTOMER_SEGMENTS = ("Low", "Mid", "High", "VIP")
CLV_TIERS = ("Low CLV", "Mid CLV", "High CLV", "VIP CLV")

# Right-closed bands as (exclusive lower edge, inclusive upper edge, label).
DISCOUNT_BANDS = (
    (-0.0001, 0.0, "No Discount"), (0.0, 0.1, "Low"), (0.1, 0.3, "Medium"),
    (0.3, 0.5, "High"), (0.5, 1.0, "Very High"),
)
BASKET_BANDS = (
    (0, 1, "1 item"), (1, 3, "2-3 items"), (3, 5, "4-5 items"), (5, 10, "6-10 items"), (10, None, "10+ items"),
)
AGE_BANDS = ((0, 25, "Gen Z"), (25, 35, "Millennial"), (35, 50, "Gen X"), (50, 100, "Boomer"))
EMPLOYEE_BANDS = ((0, 5, "1-5"), (5, 8, "6-8"), (8, 10, "9-10"), (10, 20, "11+"))
ABC_BANDS = ((0, 0.8, "A"), (0.8, 0.95, "B"), (0.95, 1.0, "C"))

# Labels of discount status.
NO_CAMPAIGN = "No Campaign"
STATUS_NONE = "No Discount"
STATUS_CAMPAIGN = "Campaign Discount"
STATUS_UNUSED = "Campaign Listed / No Discount Applied"
STATUS_OTHER = "Non-Campaign Discount"

# Columns of the final fact table, in order.
FINAL_COLUMNS = (
    "source_rowid", "invoice_id", "line_no", "customer_id", "product_id", "size", "color", "unit_price",
    "quantity", "transaction_datetime", "transaction_date", "discount", "line_total", "store_id",
    "employee_id", "currency", "currency_symbol", "sku", "transaction_type", "payment_method",
    "invoice_total", "has_line_no", "has_customer_id", "has_product_id", "has_unit_price", "has_quantity",
)
