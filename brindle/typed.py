"""A typed collection on top of a DataFrame: columns _1, _2, ... and functions from columns to columns.

A function gets the collection's columns as arguments (one for a scalar collection) and returns a column or a tuple of
them, so the whole chain is one Catalyst plan. Functions that need loops go through `map_batches` (Arrow batches).
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import ordered


class Typed:
    def __init__(self, df: DataFrame):
        self.df = df.toDF(*(f"_{i + 1}" for i in range(len(df.columns))))

    @classmethod
    def from_range(cls, spark: SparkSession, first: int, last: int) -> Typed:
        """Whole numbers from first to last, both included, made where they are used."""
        return cls(spark.range(first, last + 1))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable, schema: str) -> Typed:
        return cls(spark.createDataFrame(list(rows), schema))

    @property
    def columns(self) -> list[Column]:
        return [F.col(c) for c in self.df.columns]

    def _call(self, f: Callable) -> list[Column]:
        out = f(*self.columns)
        return list(out) if isinstance(out, tuple) else [out]

    def map(self, f: Callable) -> Typed:
        return Typed(self.df.select(*(c.alias(f"c{i}") for i, c in enumerate(self._call(f)))))

    def filter(self, f: Callable) -> Typed:
        return Typed(self.df.where(f(*self.columns)))

    def flat_map(self, f: Callable) -> Typed:
        """f returns an array column; each element becomes a row."""
        return Typed(self.df.select(F.explode(f(*self.columns))))

    def reduce(self, f: str | Callable) -> object:
        """One value of a scalar collection, or None if it is empty.

        "sum", "product", "min", "max", "xor", "and", "or", "all" and "any" (also as operator.add, mul, xor, and_, or_ and as
        min, max, all, any) are native aggregates. Any other function must be associative and commutative: values are folded
        by task, then the tasks' values are folded."""
        named = {operator.add: "sum", operator.mul: "product", min: "min", max: "max", operator.xor: "xor", operator.and_: "and", operator.or_: "or", all: "all", any: "any"}.get(f, f)
        c = self.columns[0]
        if isinstance(named, str):
            agg = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "xor": F.bit_xor, "and": F.bit_and, "or": F.bit_or, "all": F.bool_and, "any": F.bool_or}[named](c)
            return self.df.agg(agg.alias("x")).first()[0]

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc, some = None, False
            for b in batches:
                for x in b["_1"].tolist():
                    acc, some = (f(acc, x), True) if some else (x, True)
            if some:
                yield pd.DataFrame({"_1": [acc]})

        acc, some = None, False
        for r in self.df.where(c.isNotNull()).mapInPandas(fold, self.df.select("_1").schema).toLocalIterator():  # one value a task
            acc, some = (f(acc, r[0]), True) if some else (r[0], True)
        return acc

    def group_by(self, f: Callable) -> DataFrame:
        """A grouped view by key; aggregate it with `.agg(...)` so that no group is ever gathered."""
        return self.df.groupBy(f(*self.columns).alias("key"))

    def group_values(self, f: Callable, most: int = 10_000) -> DataFrame:
        """(key, part, values): the values of each key, in rows of at most `most` of them, so that a key with many values is a
        few rows and never one task's whole memory. Values are structs if the collection has several columns; their order
        is that of the columns. Null keys are a key."""
        value = F.struct(*self.columns) if len(self.df.columns) > 1 else self.columns[0]
        rows = ordered.numbered(self.df.select(f(*self.columns).alias("key"), value.alias("value")), ["key"], ["value"], "n")
        part = F.floor((F.col("n") - 1) / most).cast("int").alias("part")
        return rows.groupBy("key", part).agg(F.sort_array(F.collect_list("value")).alias("values"))

    def sort_by(self, f: Callable, ascending: bool = True) -> Typed:
        """Globally sorted, by ranges of the key."""
        key = f(*self.columns)
        return Typed(self.df.orderBy(key.asc() if ascending else key.desc()))

    def join(self, other: Typed) -> Typed:
        """Pairs (k, v) with pairs (k, w): (k, v, w)."""
        left, right = self.df.toDF("k", "v"), other.df.toDF("k", "w")
        return Typed(left.join(right, "k").select("k", "v", "w"))

    def map_batches(self, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Typed:
        return Typed(self.df.mapInPandas(f, schema))

    def collect(self) -> list:
        rows = self.df.collect()
        return [r[0] for r in rows] if len(self.df.columns) == 1 else [tuple(r) for r in rows]

    def count(self) -> int:
        return self.df.count()

    def to_df(self) -> DataFrame:
        return self.df

    def to_rdd(self):
        """The rows as an RDD of values (of tuples, if there are several columns)."""
        one = len(self.df.columns) == 1
        return self.df.rdd.map(lambda r: r[0] if one else tuple(r))
