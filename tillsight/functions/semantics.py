"""Expressions with pinned meaning: text-to-number rules, money rounding, safe ratios."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.schema import RawColumn

REAL_PREFIX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
INT_PREFIX = r"^[+-]?[0-9]+"
ISO_MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"

LOW_BITS = 24
ROUNDING = "decimal(24,9)"
ROUNDED_BELOW = 9e14  # doubles from here on have at most three decimals
EXACT = "decimal(38,6)"
PIECE = 16  # a power of two, so that splitting is exact; a rest has less than 2^24 millionths
EXACT_BELOW = 1e15  # amounts from here on are added as doubles
SATURATED = 1e26  # largest share of such amounts in a decimal sum
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def _starts_as_number(text: Column) -> Column:
    """Whether a cast may read the text: its blanks other than spaces, which the patterns do not skip, are never first."""
    return F.substring(text, 1, 1).isin(*"0123456789.+-")


def _names_number(text: Column) -> Column:
    """Hexadecimal, infinite and undefined numbers, which a cast reads and the pattern does not."""
    return text.contains("x") | text.contains("X") | text.contains("n") | text.contains("N")


def to_real(text: Column) -> Column:
    """Longest numeric prefix as double, 0.0 when there is none, NULL for NULL.

    What a cast reads as the pattern does skips the pattern.
    """
    text = F.trim(text)
    plain = F.when(_starts_as_number(text) & ~_names_number(text), text.try_cast("double"))
    prefix = F.regexp_extract(text, REAL_PREFIX, 0).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(plain, prefix, F.lit(0.0)))


def to_int(text: Column) -> Column:
    """Longest integer prefix as a 64-bit integer, 0 when there is none, NULL for NULL.

    Longer digit runs give the nearest 64-bit value.
    """
    text = F.trim(text)
    plain = F.when(_starts_as_number(text), text.try_cast("bigint"))
    prefix = F.regexp_extract(text, INT_PREFIX, 0)
    nearest = F.when(prefix.startswith("-"), F.lit(LONG_MIN)).when(prefix != "", F.lit(LONG_MAX))
    return F.when(text.isNotNull(), F.coalesce(plain, prefix.try_cast("bigint"), nearest, F.lit(0).cast("bigint")))


def finite(number: Column) -> Column:
    """The number, or NULL for NaN and for what no double can hold."""
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def to_number_or_null(value: Column) -> Column:
    """Whole-string numeric parse; anything else becomes NULL."""
    text = F.trim(value.cast("string"))
    return finite(F.when(text.rlike(REAL_PREFIX + "$"), text.try_cast("double")))


def to_day(text: Column) -> Column:
    """Calendar day of an ISO date or date-time; NULL when malformed or impossible."""
    return F.when(text.rlike(ISO_MOMENT), F.to_date(F.try_to_timestamp(text)))


def _usable(real: Column) -> Column:
    return (real != -1.0) & (F.abs(real) < F.lit(float("inf")))


def is_dirty(rule: RawColumn) -> Column:
    """True when a raw value is missing, one of its column's placeholders, or a number that no double can hold."""
    raw = F.col(rule.name)
    dirty = raw.isNull() | F.trim(raw).isin(*rule.placeholders)
    if rule.numeric:
        dirty = dirty | ~_usable(to_real(raw))
    return dirty


def clean_value(rule: RawColumn) -> Column:
    """Typed value of a raw column, NULL when dirty."""
    raw = F.col(rule.name)
    convert = {"real": to_real, "int": to_int}.get(rule.kind, F.trim)
    return F.when(~is_dirty(rule), convert(raw))


def parsed(raw: DataFrame, rules: Sequence[RawColumn], keep: Sequence[str] = ("source_rowid",)) -> DataFrame:
    """Trimmed text of each column, and its numeric readings as ``<name>_real`` and ``<name>_int``, beside the columns to keep."""
    columns = []
    for rule in rules:
        text = F.col(rule.name)
        columns.append(F.trim(text).alias(rule.name))
        if rule.numeric:
            columns.append(to_real(text).alias(f"{rule.name}_real"))
        if rule.kind == "int":
            columns.append(to_int(text).alias(f"{rule.name}_int"))
    return raw.select(*keep, *columns)


def typed(parsed_rows: DataFrame, rules: Sequence[RawColumn], keep: Sequence[str] = ("source_rowid",)) -> DataFrame:
    """Clean values over ``parsed`` columns, so no parse is repeated by its placeholder test."""
    columns = []
    for rule in rules:
        sound = ~F.col(rule.name).isin(*rule.placeholders)
        value = F.col(rule.name)
        if rule.numeric:
            sound = sound & _usable(F.col(f"{rule.name}_real"))
            value = F.col(f"{rule.name}_{rule.kind}")
        columns.append(F.when(sound, value).alias(rule.name))
    return parsed_rows.select(*keep, *columns)


def _summed(amount: Column) -> tuple[Column, Column]:
    """Exact sum of the amounts below ``EXACT_BELOW`` as a decimal, and the double sum of those beyond.

    Amounts are split into multiples of ``PIECE`` and millionths, both summed as longs, so the per-row work stays in
    long and double arithmetic; the decimal is built once per group. The low sum holds 2^39 rows, and the high one
    150,000 amounts of 1e15. Amounts that no double can hold are left out.
    """
    amount = amount.cast("double")
    size = F.abs(amount)
    high = F.floor(size * F.lit(1.0 / PIECE))
    low = F.floor((size - high * F.lit(float(PIECE))) * F.lit(1e6) + F.lit(0.5))
    small, large = size < F.lit(EXACT_BELOW), (size >= F.lit(EXACT_BELOW)) & (size < F.lit(float("inf")))

    def signed(part: Column) -> Column:
        return F.sum(F.when(small, F.when(amount < 0, -part).otherwise(part)).when(large, 0)).cast("decimal(20,0)")

    exact = ((signed(high) * F.lit(PIECE * 1_000_000) + signed(low)) * F.lit(Decimal("0.000001"))).cast(EXACT)
    return exact, F.coalesce(F.sum(F.when(large, amount)), F.lit(0.0))


def exact_sum(amount: Column) -> Column:
    """Order-independent sum as ``decimal(38,6)``; NULL over no rows.

    The share of amounts from ``EXACT_BELOW`` on is added as doubles and enters with at most ``SATURATED``, so no amount
    makes a sum of many such sums overflow.
    """
    exact, beyond = _summed(amount)
    return (exact + F.greatest(F.least(beyond, F.lit(SATURATED)), F.lit(-SATURATED)).cast(EXACT)).cast(EXACT)


def whole_sum(count: Column) -> Column:
    """Sum of integers as bigint, the nearest 64-bit value if it is beyond; NULL over no rows."""
    count = count.cast("bigint")
    high = F.sum(F.shiftright(count, LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(count.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).cast("decimal(20,0)")
    whole = high * F.lit(1 << LOW_BITS) + low
    return F.greatest(F.least(whole, F.lit(Decimal(LONG_MAX))), F.lit(Decimal(LONG_MIN))).cast("bigint")


def magnitude(count: Column) -> Column:
    """Absolute value of an integer in its own type, the largest one for the smallest."""
    return F.when(count >= 0, count).otherwise(F.coalesce(F.try_subtract(F.lit(0), count), -(count + 1)))


def round_half_up(x: Column, places: int) -> Column:
    """Decimal half-away-from-zero rounding of a double of any size."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(ROUNDED_BELOW), F.round(x.cast(ROUNDING), places).cast("double")).otherwise(F.round(x, places))


def money(x: Column) -> Column:
    return round_half_up(x, 2)


def total(amount: Column) -> Column:
    """Exact sum as double; NULL over no rows."""
    exact, beyond = _summed(amount)
    return exact.cast("double") + beyond


def total_or_zero(amount: Column) -> Column:
    return F.coalesce(total(amount), F.lit(0.0))


def mean(amount: Column) -> Column:
    """Exact average of the non-NULL values."""
    return F.try_divide(total(amount), F.count(amount).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def tally(condition: Column) -> Column:
    """Number of rows meeting a condition; NULL over no rows."""
    return F.sum(F.when(condition, 1).otherwise(0))


def tally_or_zero(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def percent(part: Column, whole: Column) -> Column:
    return round_half_up(F.try_divide(part * F.lit(100.0), whole), 2)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over pairs with both values; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def blank_label(raw: Column) -> Column:
    """Trimmed raw text with NULL and blanks shown as ``[blank]``."""
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("[blank]"))
