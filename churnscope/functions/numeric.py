"""Numeric helpers shared by every metric.

All of them are plain Column expressions, so they stay inside whole-stage
codegen and behave the same on every executor.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.functions._cols import as_col

_WHOLE = "decimal(38,0)"
# Binary floating point has no exact hundredths; such measures count in units of 1e-8.
_FLOAT_SCALE = 8


def rounded_fraction(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    """ROUND(numerator / denominator, digits) of two whole numbers, ties away from zero.

    Integer arithmetic throughout, so the result is that of the exact quotient
    whatever the group's size: dividing in floating point, or rounding twice,
    would lift quotients just under a tie. NULL for a denominator of 0. A
    value past 38 digits fails (ANSI) instead of being wrong.
    """
    n = as_col(numerator).cast(_WHOLE)
    d = F.nullif(as_col(denominator).cast(_WHOLE), F.lit(0).cast(_WHOLE))
    # Half up on magnitudes: floor((2 |n| 10^digits + |d|) / (2 |d|)).
    units = F.call_function("div", F.abs(n) * F.lit(2 * 10**digits) + F.abs(d), F.abs(d) * F.lit(2))
    signed = F.when((n < 0) != (d < 0), -units).otherwise(units)
    return (signed.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(18,{digits})")


def rounded_percent(hits: Column | str, total: Column | str, digits: int = 2) -> Column:
    """hits / total * 100, rounded exactly; NULL (not an error) when total is 0."""
    return rounded_fraction(as_col(hits).cast(_WHOLE) * F.lit(100), total, digits)


def whole_units(col: Column | str, data_type: T.DataType) -> tuple[Column, int]:
    """A numeric column as whole units and the number of units in 1: cents and 100 for decimal(p, 2)."""
    c = as_col(col)
    if isinstance(data_type, T.DecimalType):
        scale = data_type.scale
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        scale, c = _FLOAT_SCALE, c.cast(f"decimal(30,{_FLOAT_SCALE})")
    else:
        scale = 0
    # Widths that leave sums ten more digits.
    return (c.cast(f"decimal({28 - 8 + scale},{scale})") * F.lit(10**scale)).cast("decimal(28,0)"), 10**scale


def day_number(col: Column | str) -> Column:
    """Calendar day of a date or timestamp as days since 1970-01-01.

    The time of day is dropped first, so 23:00 to 01:00 is one day (MySQL
    DATEDIFF semantics), and sums of day numbers are exact integers, so spans
    can be summed per entity before a join.
    """
    return F.unix_date(F.to_date(as_col(col)))


# Microseconds that no date reaches; the width of a packed id, which is shifted to be positive.
_NO_DATE, _ID_SPAN, _ID_SHIFT = -(10**18), 2 * 10**19, 2**63 + 1


def packed_order(date: Column | str, date_type: T.DataType, id: Column | str) -> Column:
    """(date, id) as one decimal(38,0) that sorts like the pair, a NULL before all values.

    A fixed-width key lets ``max_by`` run in a hash aggregation, where a struct
    of both would need a sort. ``date`` is a date or timestamp up to the year
    9999, ``id`` a whole number of up to 64 bits.
    """
    c = as_col(date)
    if isinstance(date_type, T.TimestampType):
        micros = F.unix_micros(c)
    else:
        micros = F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
        if isinstance(date_type, T.TimestampNTZType):  # by its fields: a cast would go through a time zone
            second = F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)
            micros = micros + (F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)).cast("long") * F.lit(1_000_000) + second.cast("long")
    at = F.coalesce(micros, F.lit(_NO_DATE)).cast("decimal(19,0)") * F.lit(Decimal(_ID_SPAN))
    return (at + F.coalesce(as_col(id).cast("decimal(20,0)") + F.lit(Decimal(_ID_SHIFT)), F.lit(Decimal(0)))).cast(_WHOLE)
