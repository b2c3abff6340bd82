"""Set operators on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import ordered


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def is_unique(df: DataFrame, column: str) -> DataFrame:
    """One row: whether every value occurs once. Counted by value, never gathered."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("is_unique"))


def unique_index(df: DataFrame, value: str, index: str) -> DataFrame:
    """Each value with the smallest index that has it, and how often it occurs."""
    return df.groupBy(value).agg(F.min(index).alias("first_index"), F.count(F.lit(1)).alias("n"))


def merge_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables, repeated rows kept."""
    return a.unionByName(b)


def merge_sorted(tables: list[DataFrame], keys: list[str], descending: bool = False, source: str | None = None) -> DataFrame:
    """Any number of tables with the same columns as one in the order of the keys, repeated rows and other columns
    (payload) kept. Of equal keys those of the earlier table come first; `source` names a column for the table's number."""
    name = source or "_source"
    all_rows = reduce(DataFrame.unionByName, (t.withColumn(name, F.lit(i)) for i, t in enumerate(tables)))
    out = all_rows.orderBy(*(F.col(k).desc() if descending else F.col(k).asc() for k in keys), name)
    return out if source else out.drop(name)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, each as often, in any order. Counted by row on both sides, and compared."""
    if a.columns != b.columns or [f.dataType for f in a.schema] != [f.dataType for f in b.schema]:
        return False
    n = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_n").alias("_n"))
    return n.where("_n <> 0").isEmpty()


def same_order(a: DataFrame, by_a: list, b: DataFrame, by_b: list) -> bool:
    """Whether two tables have the same rows in the order of the given columns."""
    number = lambda df, by: ordered.numbered(df, [], by, "_i")
    return same_rows(number(a, by_a), number(b, by_b))
