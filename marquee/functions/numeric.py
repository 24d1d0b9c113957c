"""Number helpers: money sums, exact shares, text parsing, currency labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import Col, _col

MONEY_TOTAL = "decimal(20,2)"

# The number forms a browser reads from the start of a text.
LEADING_FLOAT = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
LEADING_INT = r"^\s*([+-]?[0-9]+)"


def money_sum(value: Col) -> Column:
    return F.sum(_col(value)).cast(MONEY_TOTAL)


def money_avg(value: Col) -> Column:
    """Average of a decimal column as a double, from the exact decimal sum."""
    return F.try_divide(money_sum(value).cast("double"), F.count(_col(value)))


def percent_of(part: Col, total: Col) -> Column:
    """``part`` in percent of ``total``, one decimal, halves rounded up, null for total 0.

    Works on whole numbers, so no binary fraction decides a tie.
    """
    p, t = _col(part).cast("bigint"), F.nullif(_col(total).cast("bigint"), F.lit(0))
    return F.floor((p * 2000 + t) / (t * 2)).cast("double") / F.lit(10.0)


def guarded_ratio(numerator: Col, denominator: Col) -> Column:
    return _col(numerator) / F.nullif(_col(denominator), F.lit(0))


def parse_float(text: Col) -> Column:
    """Leading number of a text; null or empty counts as 0, no number at all is NaN."""
    t = _col(text)
    found = F.regexp_extract(t, LEADING_FLOAT, 1)
    return (
        F.when(t.isNull() | (t == ""), F.lit(0.0))
        .when(found == "", F.lit(float("nan")))
        .otherwise(found.try_cast("double"))
    )


def parse_int(text: Col) -> Column:
    """Leading whole number of a text; null or empty counts as 0, none at all is null."""
    t = _col(text)
    found = F.regexp_extract(t, LEADING_INT, 1)
    return F.when(t.isNull() | (t == ""), F.lit(0).cast("bigint")).otherwise(
        F.nullif(found, F.lit("")).try_cast("bigint")
    )


def _plain(value: Column) -> Column:
    """Decimal as text without trailing zeros."""
    text = F.regexp_replace(value.cast("decimal(30,6)").cast("string"), r"0+$", "")
    return F.regexp_replace(text, r"\.$", "")


def fmt_currency(value: Col) -> Column:
    """Peso label with thousands groups and two to three decimals; null is 0."""
    amount = F.coalesce(_col(value).cast("decimal(30,6)"), F.lit(0).cast("decimal(30,6)"))
    # format_number alone rounds halves to even, so round first
    text = F.format_number(F.round(amount, 3), 3)
    return F.concat(F.lit("₱"), F.regexp_replace(text, "0$", ""))


def fmt_axis(value: Col) -> Column:
    """Short axis label: millions with one decimal, rounded thousands, else the number."""
    v = _col(value).cast("decimal(30,6)")
    millions = F.round(v / F.lit(1_000_000), 1).cast("decimal(30,1)").cast("string")
    thousands = F.round(v / F.lit(1_000), 0).cast("bigint").cast("string")
    return (
        F.when(v >= 1_000_000, F.concat(F.lit("₱"), millions, F.lit("M")))
        .when(v >= 1_000, F.concat(F.lit("₱"), thousands, F.lit("k")))
        .otherwise(F.concat(F.lit("₱"), _plain(v)))
    )


def seat_grid_column(number: Col) -> Column:
    """Grid column of a seat; aisles follow seats 5 and 15."""
    n = _col(number)
    return n + F.when(n > 15, 2).when(n > 5, 1).otherwise(0)


def order_total(seats: Col, price: Col) -> Column:
    return (F.size(_col(seats)) * _col(price)).cast(MONEY_TOTAL)
