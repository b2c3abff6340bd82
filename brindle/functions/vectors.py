"""Arithmetic on columns of number arrays, element by element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if an array, or an element of only one, is missing."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(squared_sum(v))


def axpy(k: float, x: Column, y: Column) -> Column:
    """k * x + y."""
    return F.zip_with(x, y, lambda a, b: a.cast("double") * k + b.cast("double"))


def each(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(v, lambda x: f(x.cast("double")))


def both(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v))


def squared_deviations(v: Column) -> Column:
    """Sum of the squared differences from the mean."""
    m = mean(v)
    return F.aggregate(F.transform(v, lambda x: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda s, x: s + x)


def argmax(v: Column) -> Column:
    """Place (from 0) of the first largest element."""
    return F.array_position(v, F.array_max(v)) - 1


def argmin(v: Column) -> Column:
    return F.array_position(v, F.array_min(v)) - 1


def logsumexp(v: Column) -> Column:
    """log of the sum of exponentials, shifted by the maximum."""
    m = F.array_max(v).cast("double")
    return m + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - m)))


def count_if(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(v, f))


def arrange(first: Column | int, end: Column | int, step: int = 1) -> Column:
    """Whole numbers from first up to end (left out), by a step other than 0; empty where there are none."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    first, end = lit(first), lit(end)
    last = end - (1 if step > 0 else -1)
    there = last >= first if step > 0 else last <= first
    return F.when(there, F.sequence(first, F.when(there, last).otherwise(first), F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def full(n: Column | int, value: Column | float) -> Column:
    """n times the same value; with 0 and 1 the vectors of zeros and ones."""
    return F.array_repeat(value if isinstance(value, Column) else F.lit(value), n)


def order(v: Column) -> Column:
    """Places (from 0) of the elements in ascending order, the first of equals first."""
    pairs = F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def encode_unique(v: Column) -> Column:
    """For every element the place (from 0) of its value among the array's different values in ascending order."""
    different = F.array_sort(F.array_distinct(v))
    return F.transform(v, lambda x: (F.array_position(different, x) - 1).cast("int"))


def scaled_sum(v: Column, k: float) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * k)


def is_uniform(v: Column) -> Column:
    """Whether all elements are equal; so they are where there are none."""
    return F.size(F.array_distinct(v)) <= 1


def smaller(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def larger(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def places(v: Column, f: Callable[[Column], Column]) -> Column:
    """Places (from 0) of the elements for which a condition holds."""
    marked = F.transform(v, lambda x, i: F.when(f(x), i))
    return F.filter(marked, lambda i: i.isNotNull())
