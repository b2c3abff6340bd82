"""Date and time helpers beyond the built-in functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Nanoseconds of the units of fixed length.
NANOS = {"nanosecond": 1, "microsecond": 10**3, "millisecond": 10**6, "second": 10**9, "minute": 60 * 10**9, "hour": 3600 * 10**9, "day": 86400 * 10**9, "week": 7 * 86400 * 10**9}


def months_apart(a: Column, b: Column) -> Column:
    """Calendar months from b to a, days of the month disregarded."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def years_apart(a: Column, b: Column) -> Column:
    return F.year(a) - F.year(b)


def add(c: Column, unit: str, n: int) -> Column:
    """A time moved by n units (microsecond to year); month ends are clamped to the shorter month."""
    return F.timestamp_add(unit.upper(), F.lit(n), c)


def add_nanos(nanos: Column, unit: str, n: int) -> Column:
    """A count of nanoseconds since 1970 moved by n units of fixed length (nanosecond to week)."""
    return nanos.cast("bigint") + F.lit(n * NANOS[unit]).cast("bigint")


def nanos_apart(unit: str, a: Column, b: Column) -> Column:
    """Whole units (nanosecond to week) from b to a, both counts of nanoseconds, cut towards zero."""
    apart = a.cast("decimal(20,0)") - b.cast("decimal(20,0)")
    return F.when(apart < 0, -1).otherwise(1) * F.floor(F.abs(apart) / F.lit(NANOS[unit])).cast("bigint")


def nanosecond(nanos: Column) -> Column:
    """Nanoseconds within the second of a count of nanoseconds since 1970."""
    return F.pmod(nanos.cast("bigint"), F.lit(NANOS["second"])).cast("int")


def apart(unit: str, a: Column, b: Column) -> Column:
    """Whole units from b to a, cut towards zero."""
    return F.timestamp_diff(unit.upper(), b, a)


def from_nanos(c: Column) -> Column:
    """Time of a count of nanoseconds since 1970; what is below a microsecond is lost."""
    return F.timestamp_micros(F.floor(c.cast("decimal(20,0)") / 1000).cast("bigint"))


def parse(c: Column, pattern: str) -> Column:
    """Time by a pattern; null where the text does not follow it."""
    return F.try_to_timestamp(c, F.lit(pattern))
