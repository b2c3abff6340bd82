"""Joins that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import ordered
from brindle.storage import materialize

#: Bytes of a side that may be sent to all tasks; rows of a range of the other side in an inequality join; most ranges.
BROADCAST_BYTES, RANGE_ROWS, RANGES = 64 << 20, 100_000, 1000


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size: of files, their bytes, which may be compressed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows: fixed widths, and the lengths of texts and of nested values (as JSON)."""
    size = F.lit(8 * (len(df.columns) + 1))
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct", "variant"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return int(df.agg(F.sum(size.cast("bigint"))).first()[0] or 0)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table's rows have at most so many bytes. Tables that are estimated far above the bound are not measured."""
    return plan_bytes(df) <= 16 * most and measured_bytes(df) <= most


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its measured size is within the bound; else the shuffle join stays."""
    return F.broadcast(df) if is_small(df, most) else df


def star_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Lookup join that demands a unique key on the right: every left row meets one right row at most.

    A repeated right key raises an error when the join runs. The check is an aggregate on the join key, so where the
    sides are shuffled it needs no shuffle of its own. Null keys meet nothing."""
    others = [c for c in right.columns if c != key]
    once = right.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.first(c).alias(c) for c in others), F.count(F.lit(1)).alias("_n"))
    checked = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("right key is not unique: "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return left.join(maybe_broadcast(checked.where(F.coalesce(F.col("_ok"), F.lit(True))).select(key, *others)), key, how)


_OPS = ("<", "<=", ">", ">=")
#: Cuts that are looked at one by one for the range of a value.
BLOCK = 32


def inequality_counts(left: DataFrame, right: DataFrame, a: str, op: str, b: str, out: str = "n") -> DataFrame:
    """Left rows with the number of right rows for which a < b (or <=, >, >=) holds, by sorted search: the pairs are counted
    and never made, whatever the sizes. A null meets nothing, so its number is 0."""
    if op not in _OPS:
        raise ValueError("op is one of < <= > >=")
    keys = right.select(F.col(b).alias("_b")).where("_b is not null")
    probes = left.withColumn("_b", F.col(a).cast(keys.schema["_b"].dataType))
    found = ordered.bounds(keys, probes, ["_b"], op in ("<", "<="), "_lower", "_upper")
    return found.withColumn(out, F.coalesce(F.col("_lower" if op in ("<", ">") else "_upper"), F.lit(0).cast("bigint"))).drop("_b", "_lower", "_upper")


def inequality_join(left: DataFrame, right: DataFrame, a: str, op: str, b: str, most: int = BROADCAST_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All pairs with a < b (or <=, >, >=); the result is quadratic by nature. Where only their number is wanted, use
    `inequality_counts`, for aggregates of them `inequality_packs`. Nulls meet nothing.

    A side of at most `most` bytes is sent to all tasks. Else the right side is cut into ranges of about `range_rows` rows,
    and a left row goes to its own range and those beyond it, with all of whose rows it makes pairs: an ordinary join on the
    range, whose input is small against its result. AQE splits a range with one hot value. Catalyst's estimate of the left
    side knows nothing of its copies, so it is told not to send them to all tasks."""
    on = _compare(F.col(a), op, F.col(b))
    if is_small(right, most):
        return left.join(F.broadcast(right), on)
    if is_small(left, most):
        return F.broadcast(left).join(right, on)
    known = right.where(F.col(b).isNotNull())
    cuts = _cuts(known, b, range_rows)
    here, last = _place(F.col(a), cuts), F.lit(len(cuts))
    span = F.sequence(here, last) if op in ("<", "<=") else F.sequence(F.lit(0), here)
    copies = left.where(F.col(a).isNotNull()).withColumn("_range", F.explode(span))
    return copies.hint("merge").join(known.withColumn("_range", _place(F.col(b), cuts)), "_range").where(on).drop("_range")


def inequality_packs(left: DataFrame, right: DataFrame, a: str, op: str, b: str, parts: dict[str, tuple[Column, Callable[[str], Column]]], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The pairs with a < b (or <=, >, >=) in packs: left rows with aggregates of right rows, every pair in one pack. For
    aggregates of the pairs, which then are never made. Nulls meet nothing.

    `parts` are an aggregate of right rows and the function that combines such aggregates, by the name of its column, as
    n=(F.count(F.lit(1)), F.sum). The right side is folded to its different values, and these are cut into ranges as in
    `inequality_join`: a left row gets a pack for each value of its own range that it meets, and one for all ranges beyond."""
    on = _compare(F.col(a), op, F.col("_y"))
    known = right.where(F.col(b).isNotNull())
    cuts = _cuts(known, b, range_rows)
    values = known.groupBy(F.col(b).alias("_y")).agg(*(f.alias(c) for c, (f, _) in parts.items())).withColumn("_range", _place(F.col("_y"), cuts))
    values = materialize(values, "values")
    combined = [f(c).alias(c) for c, (_, f) in parts.items()]
    ranges = values.groupBy(F.col("_range").alias("_there")).agg(*combined)  # at most RANGES rows, as the next
    every = left.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_range"))
    beyond = every.join(F.broadcast(ranges), F.col("_there") > F.col("_range") if op in ("<", "<=") else F.col("_there") < F.col("_range")).groupBy("_range").agg(*combined)
    placed = left.where(F.col(a).isNotNull()).withColumn("_range", _place(F.col(a), cuts))
    own = placed.join(values, "_range").where(on).select(*left.columns, *parts)
    return own.unionByName(placed.join(F.broadcast(beyond), "_range").select(*left.columns, *parts))


def _compare(x: Column, op: str, y: Column) -> Column:
    if op not in _OPS:
        raise ValueError("op is one of < <= > >=")
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _place(c: Column, cuts: list) -> Column:
    """The number of a value's range: how many cuts are less."""
    if len(cuts) < BLOCK:
        return sum((F.when(c > F.lit(k), 1).otherwise(0) for k in cuts), F.lit(0))
    below = lambda some: F.size(F.filter(some, lambda k: c > k))
    blocks = below(F.array(*map(F.lit, cuts[BLOCK - 1 :: BLOCK]))) * BLOCK  # whole blocks of cuts, then those of one
    return blocks + below(F.slice(F.array(*map(F.lit, cuts)), blocks + 1, BLOCK))


def _cuts(known: DataFrame, b: str, range_rows: int) -> list:
    """The values at which ranges of about so many rows end, in order, without the last. Only these come to the driver."""
    n = min(RANGES, max(1, -(-known.count() // range_rows)))
    if n == 1:
        return []
    some = known.select(b).sample(min(1.0, 50 / range_rows), 1)  # only where to cut hangs on it; 50 values a range
    counts = materialize(some.groupBy(b).agg(F.count(F.lit(1)).alias("_n")), "cuts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    run = ordered.prefix_sum(counts, [], [b], F.col("_n"), "_seen")
    ends = lambda c: F.expr(f"{c} * {n} div {total}")
    return sorted(r[0] for r in run.where((ends("_seen") > ends("(_seen - _n)")) & (F.col("_seen") < total)).select(b).collect()) if total else []


#: An interval is kept in buckets of which it touches at most so many (and one more); wider ones go to a coarser level.
TOUCHED = 8


def band_join(left: DataFrame, right: DataFrame, x: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with low <= x <= high (and equal `on` columns): points of the left, intervals of the right.

    Buckets have levels: those of level k are TOUCHED**k times `width` wide. An interval falls into the at most TOUCHED + 1
    buckets that it touches at the finest level at which they are so few, however wide it is, and a point into its
    bucket of each level that has intervals. The join is on level and bucket, so it is an ordinary hash-partitioned join. Choose
    a width near the typical length of an interval. AQE splits heavy buckets. Rows with a null or NaN in x, low or high
    meet nothing, and infinite ends are allowed."""
    on = on or []
    number = lambda c: F.col(c).cast("double")
    end = 1e15 * width  # beyond it all buckets are one
    cut = lambda c: F.least(F.greatest(number(c), F.lit(-end)), F.lit(end))
    bucket = lambda c, level: F.floor(cut(c) / (F.lit(float(width)) * F.pow(F.lit(float(TOUCHED)), level)))
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(number(c))
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest((cut(high) - cut(low)) / width, F.lit(1.0))) / F.log(F.lit(float(TOUCHED))) - 1)).cast("int")
    spans = right.where(known(low) & known(high) & (F.col(low) <= F.col(high))).withColumn("_level", level)
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # fewer than 20
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(low, F.col("_level")), bucket(high, F.col("_level")))))
    points = left.where(known(x)).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", bucket(x, F.col("_level")))
    return points.join(spans, [*on, "_level", "_bucket"]).where((F.col(x) >= F.col(low)) & (F.col(x) <= F.col(high))).drop("_level", "_bucket")


def lookup_misses(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key the right lacks; null keys are missing."""
    return left.join(right.select(key).distinct(), key, "left_anti")
