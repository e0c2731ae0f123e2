"""Literals of the SQL twins, stated on their own so that a change in the library shows as a difference.

All values here are fixed: labels, band edges, placeholders and column lists that the results must give.
"""

from __future__ import annotations

from typing import NamedTuple


class Raw(NamedTuple):
    name: str
    kind: str
    placeholders: tuple[str, ...]
    label: str
    meaning: str

    @property
    def numeric(self) -> bool:
        return self.kind in ("real", "int")


RAW_COLUMNS = (
    Raw("invoice_id", "text", ("", "N/A", "unknown"), "identifier", "Invoice identifier; groups multiple product lines in one transaction"),
    Raw("line_no", "int", ("", "unknown"), "numeric / identifier", "Line item number within an invoice"),
    Raw("customer_id", "text", ("", "-1", "unknown", "N/A"), "identifier", "Customer identifier"),
    Raw("product_id", "text", ("", "-1", "unknown", "N/A"), "identifier", "Product identifier"),
    Raw("size", "text", ("", "N/A", "unknown"), "categorical", "Purchased item size"),
    Raw("color", "text", ("", "N/A", "unknown"), "categorical", "Purchased item color"),
    Raw("unit_price", "real", ("", "unknown"), "numeric", "Selling price per item unit"),
    Raw("quantity", "int", ("", "unknown"), "numeric", "Number of items purchased or returned"),
    Raw("date", "text", ("", "N/A", "unknown"), "datetime", "Transaction date and time"),
    Raw("discount", "real", ("", "unknown"), "numeric", "Discount rate applied to line item"),
    Raw("line_total", "real", ("", "unknown"), "numeric", "Line-level amount after discount"),
    Raw("store_id", "text", ("", "-1", "unknown", "N/A"), "identifier", "Store identifier"),
    Raw("employee_id", "text", ("", "-1", "unknown", "N/A"), "identifier", "Employee identifier"),
    Raw("currency", "text", ("", "N/A", "unknown"), "categorical", "Transaction currency"),
    Raw("currency_symbol", "text", ("", "N/A", "unknown"), "categorical", "Currency symbol"),
    Raw("sku", "text", ("", "N/A", "unknown"), "identifier / text", "Stock keeping unit; may encode product, size, and color"),
    Raw("transaction_type", "text", ("", "N/A", "unknown"), "categorical", "Sale or Return"),
    Raw("payment_method", "text", ("", "N/A", "unknown"), "categorical", "Payment channel used"),
    Raw("invoice_total", "real", ("", "unknown"), "numeric", "Invoice-level total amount"),
)
RAW = {c.name: c for c in RAW_COLUMNS}
PLACEHOLDER_REPORT = ("invoice_id", "customer_id", "product_id", "unit_price", "quantity", "line_total", "invoice_total")
INVOICE_ATTRIBUTES = (
    "customer_id", "transaction_datetime", "store_id", "employee_id", "currency", "currency_symbol", "transaction_type", "payment_method",
    "invoice_total",
)
CRITICAL_COLUMNS = ("invoice_id", "transaction_datetime", "unit_price", "quantity", "transaction_type")
TRANSACTION_TYPES = ("Sale", "Return")
PAYMENT_METHODS = ("Cash", "Credit Card")
CURRENCIES = ("USD",)
PRICE_SEGMENTS = ("Low Price", "Mid Price", "High Price", "Premium Price")
ORDER_VALUE_GROUPS = ("Low Value", "Mid Value", "High Value", "Very High Value")
CUSTOMER_SEGMENTS = ("Low", "Mid", "High", "VIP")
DISCOUNT_BANDS = ((-0.0001, 0.0, "No Discount"), (0.0, 0.1, "Low"), (0.1, 0.3, "Medium"), (0.3, 0.5, "High"), (0.5, 1.0, "Very High"))
BASKET_BANDS = ((0, 1, "1 item"), (1, 3, "2-3 items"), (3, 5, "4-5 items"), (5, 10, "6-10 items"), (10, None, "10+ items"))
AGE_BANDS = ((0, 25, "Gen Z"), (25, 35, "Millennial"), (35, 50, "Gen X"), (50, 100, "Boomer"))
EMPLOYEE_BANDS = ((0, 5, "1-5"), (5, 8, "6-8"), (8, 10, "9-10"), (10, 20, "11+"))
ABC_BANDS = ((0, 0.8, "A"), (0.8, 0.95, "B"), (0.95, 1.0, "C"))
FINAL_COLUMNS = (
    "source_rowid", "invoice_id", "line_no", "customer_id", "product_id", "size", "color", "unit_price", "quantity", "transaction_datetime",
    "transaction_date", "discount", "line_total", "store_id", "employee_id", "currency", "currency_symbol", "sku", "transaction_type",
    "payment_method", "invoice_total", "has_line_no", "has_customer_id", "has_product_id", "has_unit_price", "has_quantity",
)

#: Calendar months that the bound orders span.
MONTHS = 80
