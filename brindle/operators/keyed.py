"""Results per key where a few keys hold most of the rows.

Every aggregate here is algebraic, so each map task combines its rows into one state per key in Spark's hash aggregate
(which spills when its table is full) and only those states are shuffled: a key with a third of all rows sends one
state per map task, like any other. Distinct counts go through (key, item) first, whose hash spreads a hot key's items
over all tasks, and only then are the items counted by key, again with map-side states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import free_name


def per_key(df: DataFrame, key: str, item: str | None = None, value: str | None = None, rows: str = "n_rows", items: str = "n_items", total: str = "row_total", item_total: str = "item_total") -> DataFrame:
    """Per key: the number of rows and, if asked for, of distinct items, the sum of `value` over all rows, and its sum
    with each item counted once (rows of an item are taken to agree; else its largest value counts).

    A null key is a key of its own. Null items are not counted as items but their rows and values count in the row
    figures. Sums over no known value are null. An empty table gives no rows. Other columns are not read.
    New columns that bear the key's name get an underscore."""
    rows, items, total, item_total = (free_name(n, [key]) for n in (rows, items, total, item_total))
    k = F.col(key).alias("k")
    if item is None:
        aggs = [F.count(F.lit(1)).alias(rows)] + ([F.sum(value).alias(total)] if value else [])
        return df.groupBy(k).agg(*aggs).withColumnRenamed("k", key)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs += [F.sum(value).alias("s"), F.max(value).alias("m")]
    by_item = df.groupBy(k, F.col(item).alias("i")).agg(*aggs)
    aggs = [F.sum("n").alias(rows), F.count("i").alias(items)]
    if value:
        aggs += [F.sum("s").alias(total), F.sum(F.when(F.col("i").isNotNull(), F.col("m"))).alias(item_total)]
    return by_item.groupBy("k").agg(*aggs).withColumnRenamed("k", key)


def heavy_keys(df: DataFrame, key: str, share: int) -> DataFrame:
    """The non-null keys that hold at least one `share`-th of all rows, with their number of rows. At most `share` rows.

    The number of all rows is the sum of the per-key figures, so rows with a null key count in it. It is a single
    number that reaches every task as a scalar subquery, which reuses the shuffled states of the keys: one scan."""
    counts = per_key(df, key)
    name = free_name("n_rows", [key])
    # A condition on the key alone would be pushed into one of the two uses, and then there would be two scans.
    known = F.when(F.col(key).isNotNull(), F.col(name)).otherwise(0)
    return counts.where(known * share >= counts.agg(F.sum(name)).scalar())
