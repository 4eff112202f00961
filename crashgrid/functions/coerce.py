"""Lenient coercions: bad input becomes null, never an error.

Spark 4 runs with ANSI semantics, where a plain ``cast`` of bad text throws,
so every conversion here goes through ``try_*`` forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..schema import NAMED_MONTH_LAYOUT, NAMED_MONTH_ORDER, NAMED_MONTH_PATTERN, TIMESTAMP_FORMATS, ZONE_PATTERN
from .text import col, strip

# A plain decimal number with optional exponent and surrounding whitespace.
# Rejects texts such as "1d" or "nan" that a bare double cast would accept.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it.

    Spark writes a repeated subexpression out at every place that names it. A
    long body then becomes a method that the JVM does not compile, and each of
    its rows computes the value again and again; a lambda's variable does not.
    """
    return F.transform(F.array(value), body)[0]


def to_number(c, dtype=None) -> Column:
    """Text or number -> double; unparseable text and NaN -> null."""
    c = col(c)
    if isinstance(dtype, NumericType):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return bound(c.cast("string"), lambda text: F.when(text.rlike(NUMBER_PATTERN), strip(text).try_cast("double")))


def to_int(c) -> Column:
    """Double -> int by truncation; out-of-range -> null."""
    return col(c).try_cast("int")


def to_timestamp_any(c, dtype=None, formats=TIMESTAMP_FORMATS) -> Column:
    """Text -> timestamp_ntz trying each layout in order; no match -> null.

    A failed parse is costly (the parser signals it with an exception), so
    each layout is only tried on text of its shape, checked by a regex first.
    A trailing zone offset is taken off first; the result is then in UTC.
    """
    c = col(c)
    if isinstance(dtype, (TimestampType, TimestampNTZType, DateType)):
        return c.cast("timestamp_ntz")

    def plain(text: Column) -> Column:
        named = F.regexp_replace(text, NAMED_MONTH_PATTERN, NAMED_MONTH_ORDER)
        parsed = [F.when(text.rlike(shape), F.try_to_timestamp(named if fmt == NAMED_MONTH_LAYOUT else text, F.lit(fmt)))
                  for fmt, shape in formats]
        return F.coalesce(*parsed).cast("timestamp_ntz")

    def ahead(zone: Column) -> Column:
        digits = F.regexp_replace(zone, "[^0-9]", "")
        minutes = F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(
            F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
        return F.make_dt_interval(mins=F.when(zone.startswith("-"), -minutes).otherwise(minutes))

    def zoned(text: Column) -> Column:
        return bound(F.regexp_replace(text, ZONE_PATTERN, "$1"), plain) - bound(
            F.regexp_extract(text, ZONE_PATTERN, 2), ahead)

    return bound(strip(c.cast("string")), lambda text: F.when(text.rlike(ZONE_PATTERN), zoned(text)).otherwise(plain(text)))


def round_half_even(c, digits: int = 3) -> Column:
    """Round a double to ``digits`` places, ties to even, on the scaled value."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)
