"""Totals over trailing periods of days, days without activity included.

Rows are first combined to one total per entity and day. Days are cut into tiles of `tile` days; a tile also holds the
days of the longest period before it (its halo), so tiles are independent of each other. Entities by days of one tile
make a dense numpy block, and one product with a banded 0/1 matrix per period gives all its trailing totals.

A hot entity is only as large as its calendar (one row a day), and a task holds one block of at most
`block` entities x (tile + halo) days at a time.

Whole numbers have exact totals of up to 63 bits; larger ones are refused (an error). Of reals, NaN and infinite values
go through the same products as counts of their own, so they reach the totals of their period and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import free_name

TILE, BLOCK = 128, 1024
#: Whole numbers up to this are exact in double precision. Larger ones are multiplied in halves of HALF bits.
EXACT, HALF = 2**53, 32


def daily_totals(df: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """(entity, day, total): one row per entity and day with rows. Nulls in any of the three columns are left out."""
    known = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull())
    kind = "bigint" if df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long") else "double"
    return known.groupBy(F.col(entity).alias("entity"), F.col(day).cast("int").alias("day")).agg(F.sum(F.col(value)).cast(kind).alias("total"))


def band(days: int, period: int, halo: int) -> np.ndarray:
    """(halo + days) x days: column d is 1 for the `period` days that end with day d of the tile."""
    i, d = np.arange(halo + days)[:, None], np.arange(days)[None, :] + halo
    return ((i <= d) & (i > d - period)).astype(np.float64)


def windows(dense: np.ndarray, m: np.ndarray, period: int) -> np.ndarray:
    """The totals of a block by one band, in the type of the block."""
    if dense.dtype == np.int64:
        if not dense.size or max(int(dense.max()), -int(dense.min())) * period < EXACT:
            return (dense.astype(np.float64) @ m).astype(np.int64)
        high = ((dense >> HALF).astype(np.float64) @ m).astype(np.int64)
        low = ((dense & ((1 << HALF) - 1)).astype(np.float64) @ m).astype(np.int64)
        high += low >> HALF
        if high.size and (high.max() >= 1 << 31 or high.min() < -(1 << 31)):
            raise OverflowError("a trailing total does not fit into 64 bits")
        return (high << HALF) | (low & ((1 << HALF) - 1))
    finite = np.isfinite(dense)
    if finite.all():
        return dense @ m
    out = np.where(finite, dense, 0.0) @ m
    up, down, none = ((x.astype(np.float64) @ m) > 0 for x in (dense == np.inf, dense == -np.inf, np.isnan(dense)))
    out[up], out[down] = np.inf, -np.inf
    out[none | (up & down)] = np.nan
    return out


def _tiles(daily: DataFrame, tile: int, halo: int) -> DataFrame:
    """(entity, tile, first, last, days, totals): every tile from an entity's first to its last day, empty ones included."""
    here = F.floor(F.col("day") / tile).cast("int")
    into = F.floor((F.col("day") + halo) / tile).cast("int")  # a day belongs to the halo of the tiles up to this one
    cut = daily.repartition("entity").select("entity", "day", "total", here.alias("own"), F.explode(F.sequence(here, into)).alias("tile"))
    own = F.when(F.col("own") == F.col("tile"), F.col("day"))
    packed = cut.groupBy("entity", "tile").agg(F.collect_list(F.struct("day", "total")).alias("cells"), F.min(own).alias("lo"), F.max(own).alias("hi"))
    w = Window.partitionBy("entity")
    spans = packed.withColumns({"first": F.min("lo").over(w), "last": F.max("hi").over(w), "next": F.lead("tile").over(w.orderBy("tile"))})
    spans = spans.where(F.col("tile") <= F.floor(F.col("last") / tile))
    filled = spans.withColumn("at", F.explode(F.sequence("tile", F.greatest(F.col("tile"), F.least(F.col("next") - 1, F.floor(F.col("last") / tile).cast("int"))))))
    cells = F.when(F.col("at") == F.col("tile"), F.col("cells")).otherwise(F.array().cast(packed.schema["cells"].dataType))
    return filled.select("entity", F.col("at").alias("tile"), "first", "last", cells.alias("cells")).select("entity", "tile", "first", "last", F.col("cells.day").alias("days"), F.col("cells.total").alias("totals"))


def _blocks(batches: Iterator[pa.RecordBatch], tile: int, halo: int, block: int) -> Iterator[tuple]:
    """Sparse rows to dense blocks: the entities, tiles and spans of a block's rows, and its rows x (halo + tile) matrix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, block):
            b = batch.slice(lo, block)
            entity, tiles, first, last = (b.column(i) for i in range(4))
            tiles, first, last = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (tiles, first, last))
            days, totals = b.column(4), b.column(5)
            n = np.diff(days.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), n)
            dense = np.zeros((b.num_rows, halo + tile), totals.type.value_type.to_pandas_dtype())
            dense[row, days.flatten().to_numpy().astype(np.int64) - tiles[row] * tile + halo] = totals.flatten().to_numpy(zero_copy_only=False)
            yield entity, tiles, first, last, dense


def _run(df: DataFrame, entity: str, day: str, value: str, periods: list[int], tile: int, block: int, out: str, make: Callable) -> DataFrame:
    if not periods or min(periods) < 1:
        raise ValueError("periods are whole numbers of days, 1 or more")
    halo = max(periods) - 1
    daily = daily_totals(df, entity, day, value)
    tiles = _tiles(daily, tile, halo)
    bands = {p: band(tile, p, halo) for p in periods}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entities, t, first, last, dense in _blocks(batches, tile, halo, block):
            at = t[:, None] * tile + np.arange(tile)[None, :]
            yield from make(entities, at, first, last, dense, {p: windows(dense, m, p) for p, m in bands.items()})

    kind = daily.schema["total"].dataType.simpleString()
    return tiles.mapInArrow(run, f"entity {tiles.schema['entity'].dataType.simpleString()}, {out.replace('number', kind)}")


def trailing_totals(df: DataFrame, entity: str, day: str, value: str, periods: list[int], tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Per entity and day from its first to its last day: the day's total, and the total and daily average over each
    trailing period (`total_p`, `avg_p`; the average divides by p, days before the first count as 0).

    `day` is a count of days (int). Totals are bigint for whole numbers, else double; averages are double. Columns: the entity, `day`, `total`, and those per period; the entity's name gets an
    underscore where it clashes. Rows with a null entity, day or value are left out, other columns are not read. Repeated
    rows all count. An empty table gives no rows. A total with a NaN in its period, or with both infinities, is NaN; a
    total of whole numbers beyond 64 bits is an error."""
    periods = sorted(set(periods))
    names = ["day", "total", *(f"{k}_{p}" for p in periods for k in ("total", "avg"))]

    def make(entities, at, first, last, dense, totals) -> Iterator[pa.RecordBatch]:
        inside = (at >= first[:, None]) & (at <= last[:, None])
        row, col = np.nonzero(inside)
        for lo in range(0, len(row), 20_000):
            r, c = row[lo : lo + 20_000], col[lo : lo + 20_000]
            arrays = [entities.take(pa.array(r)), pa.array(at[r, c].astype(np.int32)), pa.array(dense[:, -at.shape[1] :][r, c])]
            for p in periods:
                t = totals[p][r, c]
                arrays += [pa.array(t), pa.array(t / p)]
            yield pa.RecordBatch.from_arrays(arrays, names=["entity", *names])

    out = "day int, total number, " + ", ".join(f"total_{p} number, avg_{p} double" for p in periods)
    return _run(df, entity, day, value, periods, tile, block, out, make).withColumnRenamed("entity", free_name(entity, names))


def trailing_extremes(df: DataFrame, entity: str, day: str, value: str, periods: list[int], tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Per entity and period: the earliest day with the highest trailing total (`high`, `high_day`) and with the lowest
    (`low`, `low_day`), over the days whose period lies wholly between the entity's first and last day. Entities without
    such a day have no row. Values should be whole numbers (cents), else totals that are equal on paper may differ in
    their last bits. Totals that are NaN are neither high nor low. Inputs are treated as in `trailing_totals`."""
    periods = sorted(set(periods))
    names = ["period", "high", "high_day", "low", "low_day"]

    def make(entities, at, first, last, dense, totals) -> Iterator[pa.RecordBatch]:
        for p in periods:
            inside = (at >= first[:, None] + p - 1) & (at <= last[:, None]) & ~np.isnan(totals[p])
            rows = np.nonzero(inside.any(axis=1))[0]
            if len(rows):
                ok, t, days = inside[rows], totals[p][rows], at[rows]
                # t where it counts; elsewhere that row's first counting total, which decides nothing
                i = np.arange(len(rows))
                t = np.where(ok, t, t[i, ok.argmax(axis=1)][:, None])
                hi, lo = (ok & (t == t.max(axis=1)[:, None])).argmax(axis=1), (ok & (t == t.min(axis=1)[:, None])).argmax(axis=1)  # the first of equals
                yield pa.RecordBatch.from_arrays(
                    [entities.take(pa.array(rows)), pa.array(np.full(len(rows), p, np.int32)), pa.array(t[i, hi]), pa.array(days[i, hi].astype(np.int32)), pa.array(t[i, lo]), pa.array(days[i, lo].astype(np.int32))],
                    names=["entity", *names],
                )

    tiles = _run(df, entity, day, value, periods, tile, block, "period int, high number, high_day int, low number, low_day int", make)
    best = tiles.groupBy("entity", "period").agg(F.max(F.struct(F.col("high").alias("t"), (-F.col("high_day")).alias("d"))).alias("h"), F.min(F.struct(F.col("low").alias("t"), F.col("low_day").alias("d"))).alias("l"))
    return best.select(F.col("entity").alias(free_name(entity, names)), "period", F.col("h.t").alias("high"), (-F.col("h.d")).alias("high_day"), F.col("l.t").alias("low"), F.col("l.d").alias("low_day"))
