"""User code over Arrow batches (as pandas frames) in the shapes one to one, one to many, many to one, join and grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.storage import free_name, materialize

#: Fixed value: the most output sets of one call.
MOST_SETS = 64


def execute(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One batch in, one batch out. Batches are parts of a partition; f sees each row once."""
    return df.mapInPandas(lambda batches: (f(b) for b in batches), schema)


def execute_multi(df: DataFrame, f: Callable[[pd.DataFrame], list[tuple[int, pd.DataFrame]]], schema: str, bucket: str = "bucket") -> DataFrame:
    """One batch in, several numbered sets out (0 to 63): rows with the number of their set in a first column `bucket`.

    Sets are told apart by that column; filter on it, or shuffle by it with `repartition`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, out in f(b):
                if not 0 <= number < MOST_SETS:
                    raise ValueError(f"the number of a set is 0 to {MOST_SETS - 1}")
                out = out.copy()
                out.insert(0, bucket, number)
                yield out

    return df.mapInPandas(run, f"{bucket} int, {schema}")


def execute_multi_in(tables: list[DataFrame], f: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Batches of several tables with the same columns in (f gets the table's number and a batch), one table out."""
    name = free_name("source", tables[0].columns)
    all_rows = reduce(DataFrame.unionByName, (t.withColumn(name, F.lit(i)) for i, t in enumerate(tables)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, part in b.groupby(name):
                yield f(int(number), part.drop(columns=name))

    return all_rows.mapInPandas(run, schema)


#: Types whose Arrow values pandas takes as they are, by name in Spark.
PLAIN = {"byte": pa.int8(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "date": pa.date32()}


def execute_join(left: DataFrame, right: DataFrame, on: list[str], f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, split: int = 1) -> DataFrame:
    """f gets the rows of both sides that agree in the columns `on`, key by key; null keys agree.

    Both groups of a call must fit into a task. With `split` the left group of a key is cut into so many parts by the hash
    of its rows, each of which meets the whole right group, so f must treat left rows independently of each other; for
    parts without left rows f is not called, so right rows that meet nothing are not seen.

    Rows of plain types come sorted by key, many keys to a batch; others go through Spark's cogroup, key by key."""
    keys = list(on)
    if split > 1:
        part = free_name("part", [*left.columns, *right.columns])
        there = [free_name(f"_met{i}", right.columns) for i in range(len(on))]
        left = materialize(left.withColumn(part, F.pmod(F.xxhash64(*left.columns), F.lit(split)).cast("int")), "parts")  # read twice, so its rows must not change
        met = left.select(*(F.col(k).alias(m) for k, m in zip(on, there)), F.col(part).alias(part)).distinct()
        right = right.join(met, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(m)) for k, m in zip(on, there)))).drop(*there)
        keys.append(part)
    out = StructType.fromDDL(schema)
    types = [t.dataType.typeName() for t in [*left.schema, *right.schema, *out]]
    if all(t in PLAIN for t in types) and all(left.schema[k].dataType == right.schema[k].dataType for k in keys):
        return _sorted_groups(left, right, keys, keys[len(on) :], f, out)
    given = lambda x: x.drop(columns=keys[len(on) :])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: f(given(a), given(b)), schema)


#: Rows that are gathered from several calls before they are passed on.
GATHERED = 10_000


def _sorted_groups(left: DataFrame, right: DataFrame, keys: list[str], hidden: list[str], f: Callable, out: StructType) -> DataFrame:
    """f over the groups of two tables of plain types, without the hidden columns. A task holds a batch and the groups at its ends."""
    names = [[c for c in df.columns if c not in hidden] for df in (left, right)]
    of = [[f"_{s}{i}" for i in range(len(names[s]))] for s in (0, 1)]
    ks = [f"_k{i}" for i in range(len(keys))]
    side = lambda df, s: df.select(F.lit(s).alias("_side"), *(F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)), *(F.col(f"`{c}`").alias(a) for c, a in zip(names[s], of[s])))
    rows = side(left, 0).unionByName(side(right, 1), allowMissingColumns=True)
    safe = left.sparkSession.conf.get("spark.sql.execution.pandas.convertToArrowArraySafely") == "true"
    types = [PLAIN[t.dataType.typeName()] for t in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows so far of the last group
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            begins = _begins(pa.concat_tables([*(h.slice(len(h) - 1) for h in held[-1:]), t]).select(ks))
            begins = begins[1:] if held else begins
            last = len(t) - 1 - int(begins[::-1].argmax()) if begins.any() else 0
            if last or (held and begins[0]):
                yield from called(pa.concat_tables([*held, t.slice(0, last)]))
                held = []
            held.append(t.slice(last))
        if held:
            yield from called(pa.concat_tables(held))

    def called(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group, right_row = np.cumsum(_begins(t.select(ks))) - 1, t["_side"].to_numpy() == 1
        n = int(group[-1]) + 1
        pairs = zip(*(_parts(t.filter(pa.array(of_side)).select(of[s]).rename_columns(names[s]), np.bincount(group[of_side], minlength=n)) for s, of_side in enumerate((~right_row, right_row))))
        some: list[pd.DataFrame] = []
        size, kinds = 0, None
        for x in (f(a, b) for a, b in pairs):
            if not len(x):
                continue
            before, kinds = kinds, [*x.columns, *x.dtypes]
            if some and (size >= GATHERED or kinds != before):  # frames of other dtypes are not mixed: numbers stay exact
                yield arrow(pd.concat(some, ignore_index=True))
                some, size = [], 0
            some.append(x)
            size += len(x)
        if some:
            yield arrow(pd.concat(some, ignore_index=True))

    def arrow(x: pd.DataFrame) -> pa.RecordBatch:
        if by_name := all(isinstance(c, str) for c in x.columns):
            if set(x.columns) != set(out.names):
                raise ValueError(f"the columns are {list(x.columns)}, and should be {out.names}")
        columns = [x[c] if by_name else x.iloc[:, i] for i, c in enumerate(out.names)]
        masks = [None if hasattr(c.array, "__arrow_array__") else c.isnull().to_numpy() for c in columns]
        return pa.RecordBatch.from_arrays([pa.Array.from_pandas(c, mask=m, type=k, safe=safe) for c, m, k in zip(columns, masks, types)], out.names)

    return rows.repartition(*ks).sortWithinPartitions(*ks, "_side").mapInArrow(run, out)


def _begins(keys: pa.Table) -> np.ndarray:
    """Whether a group begins at a row: its keys are not those of the row before. Nulls agree, and so do NaN."""
    same = np.ones(max(len(keys) - 1, 0), bool)
    for c in keys.columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        agree = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
        if pa.types.is_floating(c.type):  # but a null and NaN do not
            agree = pc.and_(agree, pc.equal(pc.is_null(a), pc.is_null(b)))
        same &= agree.to_numpy()
    return np.concatenate([[True], ~same])


def _parts(t: pa.Table, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
    """The table in frames of so many rows. Numbers with nulls become reals in pandas, so only those frames that have nulls may."""
    ends = np.cumsum(sizes).tolist()
    exact = all(c.null_count == 0 or pa.types.is_floating(c.type) or not (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type)) for c in t.columns)
    whole = t.to_pandas() if exact else None
    for end, n in zip(ends, sizes.tolist()):
        x = whole.iloc[end - n : end].copy() if exact else t.slice(end - n, n).to_pandas()
        x.index = pd.RangeIndex(n)
        yield x


def execute_grouping(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Batches in, rows with a key out, brought together by key. f sees batches, not groups, so it should combine the rows
    of a key in its batch; `merge` then combines what the batches give (an aggregate by the key, for instance), and no
    group is ever gathered in a task."""
    keyed = execute(df, f, schema)
    return merge(keyed) if merge else keyed.repartition(F.col(key))
