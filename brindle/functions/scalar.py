"""Scalar helpers that never raise on bad values: what cannot be computed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null, also in ANSI mode."""
    return F.try_divide(a, b)


def safe_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; null where b is 0."""
    return F.try_mod(a, b)


def safe_cast(c: Column, kind: str) -> Column:
    """Cast that gives null instead of an error; doubles are cut towards zero."""
    return c.try_cast(kind)


def is_even(c: Column) -> Column:
    return c % 2 == 0


def is_infinite(c: Column) -> Column:
    return F.abs(c) == float("inf")


def clip(c: Column, low, high) -> Column:
    """The nearest value within the bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def binarize(c: Column, threshold) -> Column:
    """1 above the threshold, else 0; null stays null."""
    return F.when(c.isNotNull(), (c > threshold).cast("int"))


def plain_zero(c: Column) -> Column:
    """The value with -0.0 as 0.0."""
    return c + F.lit(0.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation; null where one of the two does not vary (the built-in raises in ANSI mode there)."""
    u, v = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(u) * F.var_pop(v)))
