"""Operators over a global order, without a task that holds all rows of a key.

Rows are cut into ranges of (key, order) and written with their range's number, so that ranges never change. Within a
range a window does the work; what a range needs from those before it is a carry: one row for each range that begins
in the middle of a key, so at most one per range. Only these are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import materialize

Order = Sequence[Column | str]


class Ranges:
    """A table in ranges: its rows with `_part`, and `_n`, the row's number within its range and key."""

    def __init__(self, df: DataFrame, keys: list[str], order: Order, parts: int | None = None):
        self.keys, self.columns = keys, df.columns
        by = [*keys, *order]
        cut = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
        cut = materialize(cut.withColumn("_part", F.spark_partition_id()), "ranges")
        self.window = Window.partitionBy("_part", *keys).orderBy(*order)
        self.rows = cut.withColumn("_n", F.row_number().over(self.window))

    def carry(self, rows: DataFrame, **columns: Column) -> DataFrame:
        """`rows` with columns made from one aggregate per range and key: what it comes to over the ranges before that hold
        the key. `columns` are pairs of an aggregate over a range and key, and a function from its column and the window of
        the ranges before to the carry; null where no range before has the key."""
        ends = rows.groupBy("_part", *self.keys).agg(F.max("_n").alias("_size"), *(a.alias(c) for c, (a, _) in columns.items()))
        w = Window.partitionBy(*self.keys).orderBy("_part") if self.keys else Window.orderBy("_part")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        some = ends.select("_part", *self.keys, F.sum("_size").over(before).alias("_before"), *(f(F.col(c), before).alias(c) for c, (_, f) in columns.items())).where("_before is not null")
        keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys)]
        some = F.broadcast(some.select(F.col("_part").alias("_at"), *keys, "_before", *columns))  # at most one row per range
        same = F.col("_part") == F.col("_at")
        for i, k in enumerate(self.keys):
            same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
        return rows.join(some, same, "left").drop("_at", *(f"_key{i}" for i in range(len(self.keys))))


def _last(c: Column, before) -> Column:
    return F.last(c).over(before)


def prefix_sum(df: DataFrame, keys: list[str], order: Order, value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Running sum of a value within a key, this row included; nulls add nothing, and the sum of nulls only is null."""
    r = Ranges(df.withColumn("_v", value), keys, order, parts)
    run = r.window.rowsBetween(Window.unboundedPreceding, 0)
    rows = r.carry(r.rows, _c=(F.sum("_v"), lambda c, w: F.sum(c).over(w)))
    own = F.sum("_v").over(run)
    return rows.select(*df.columns, F.coalesce(own + F.col("_c"), own, F.col("_c")).alias(out))


def numbered(df: DataFrame, keys: list[str], order: Order, out: str, parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 within their key."""
    r = Ranges(df, keys, order, parts)
    return r.carry(r.rows).select(*df.columns, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out))


def shift(df: DataFrame, keys: list[str], order: Order, value: Column, n: int, out: str, parts: int | None = None) -> DataFrame:
    """The value n rows before within the key (after, if negative); null where there is none. By number, over any distance:
    a join on (key, number), whose hash spreads the rows of a key over all tasks."""
    rows = materialize(numbered(df.withColumn("_v", value), keys, order, "_i", parts), "numbered")
    there = rows.select(*(F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)), (F.col("_i") + n).alias("_j"), F.col("_v").alias(out))
    same = F.col("_i") == F.col("_j")
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{j}"))
    return rows.join(there, same, "left").select(*df.columns, out)


def forward_fill(df: DataFrame, keys: list[str], order: Order, value: Column, out: str, parts: int | None = None) -> DataFrame:
    """The last known value of the key up to this row."""
    r = Ranges(df.withColumn("_v", value), keys, order, parts)
    known = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_n")))
    rows = r.carry(r.rows, _c=(known, lambda c, w: F.last(c, ignorenulls=True).over(w)))
    own = F.last("_v", ignorenulls=True).over(r.window.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*df.columns, F.coalesce(own, "_c").alias(out))


def run_starts(df: DataFrame, keys: list[str], order: Order, value: str, parts: int | None = None) -> DataFrame:
    """Rows at which the value differs from the row before within its key; the first row of a key is one."""
    r = Ranges(df, keys, order, parts)
    rows = r.carry(r.rows.withColumn("_lag", F.lag(value).over(r.window)), _c=(F.max_by(value, F.col("_n")), _last))
    before = F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_c"))
    first = (F.col("_n") == 1) & F.col("_before").isNull()
    return rows.where(first | ~before.eqNullSafe(F.col(value))).select(*df.columns)


def dictionary(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """(value, code): codes from 0 in order of the values, which are the distinct ones that are not null."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return numbered(values, [], ["value"], "_i", parts).select("value", (F.col("_i") - 1).alias("code"))


def dictionary_lookup(df: DataFrame, column: str, words: DataFrame, out: str = "code") -> DataFrame:
    """Rows with the code of their value; null for values that the dictionary lacks, and for null."""
    known = words.select(F.col("value").alias("_value"), F.col("code").alias(out))
    return df.join(known, F.col(column) == F.col("_value"), "left").drop("_value")


def dictionary_merge(a: DataFrame, b: DataFrame, parts: int | None = None) -> DataFrame:
    """One dictionary for the values of two: (value, code, code_a, code_b), with the codes they had in each."""
    both = dictionary(a.select("value").union(b.select("value")), "value", parts)
    return both.join(a.toDF("value", "code_a"), "value", "left").join(b.toDF("value", "code_b"), "value", "left")


def unique_inverse(df: DataFrame, value: str, index: str, parts: int | None = None) -> DataFrame:
    """(index, code): for every row with a value, the place of its value among the distinct ones in order."""
    words = materialize(dictionary(df, value, parts), "dictionary")
    return dictionary_lookup(df.select(index, value), value, words).where(F.col(value).isNotNull()).select(index, "code")


def bounds(keys: DataFrame, probes: DataFrame, on: list[str], descending: bool | list[bool] = False, lower: str = "lower", upper: str = "upper", parts: int | None = None) -> DataFrame:
    """Sorted search: every probe with `lower`, the number of keys that come before it in the order of the columns `on`
    (each ascending or `descending`), and `upper`, the number that do not come behind it.

    Both tables have the columns `on`. Keys with a null in them are left out; probes with one have null bounds. Equal
    keys are counted before the shuffle, and each different value is searched once."""
    down = descending if isinstance(descending, list) else [descending] * len(on)
    order = [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(on, down)]
    known = lambda df: df.dropna(subset=on)
    counts = known(keys).groupBy(*on).agg(F.count(F.lit(1)).alias("_k"))
    asked = known(probes).select(*on).distinct().withColumn("_k", F.lit(0).cast("bigint"))
    values = counts.unionByName(asked).groupBy(*on).agg(F.sum("_k").alias("_k"))
    found = prefix_sum(values, [], order, F.col("_k"), "_u", parts)
    found = found.select(*(F.col(c).alias(f"_on{i}") for i, c in enumerate(on)), (F.col("_u") - F.col("_k")).alias(lower), F.col("_u").alias(upper))
    same = F.lit(True)
    for i, c in enumerate(on):
        same &= F.col(c) == F.col(f"_on{i}")
    return probes.join(found, same, "left").drop(*(f"_on{i}" for i in range(len(on))))
