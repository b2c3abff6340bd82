import random
from bisect import bisect_left, bisect_right
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.operators import ordered

R = random.Random(3)
#: One key holds most rows, keys and values may be null, and there are more ranges than keys.
ROWS = [(R.choice([None, 1, 2, 2, 2, 2, 2]), i, R.choice([None, None, 1, 2, 2, 5])) for i in range(200)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k int, o int, v int").repartition(3)


def by_key():
    out = defaultdict(list)
    for k, o, v in ROWS:
        out[k].append((o, v))
    return out


def got(out, name):
    return {r["o"]: r[name] for r in out.collect()}


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_running(df, parts):
    sums, fills, before, after, first = {}, {}, {}, {}, set()
    for rows in by_key().values():
        known, filled = None, None
        for i, (o, v) in enumerate(rows):
            if v is not None:
                known, filled = (known or 0) + v, v
            sums[o], fills[o] = known, filled
            before[o] = rows[i - 3][1] if i > 2 else None
            after[o] = rows[i + 1][1] if i + 1 < len(rows) else None
            if not i or rows[i - 1][1] != v:
                first.add(o)
    assert got(ordered.prefix_sum(df, ["k"], ["o"], F.col("v"), "s", parts), "s") == sums
    assert got(ordered.forward_fill(df, ["k"], ["o"], F.col("v"), "s", parts), "s") == fills
    assert got(ordered.shift(df, ["k"], ["o"], F.col("v"), 3, "s", parts), "s") == before
    assert got(ordered.shift(df, ["k"], ["o"], F.col("v"), -1, "s", parts), "s") == after
    starts = ordered.run_starts(df, ["k"], ["o"], "v", parts)
    assert starts.columns == ["k", "o", "v"] and {r["o"] for r in starts.collect()} == first
    n = got(ordered.numbered(df, ["k"], [F.desc("o")], "n", parts), "n")
    assert all(n[o] == len(rows) - i for rows in by_key().values() for i, (o, _) in enumerate(rows))


def test_nothing(df):
    none = df.where("false")
    assert ordered.prefix_sum(none, ["k"], ["o"], F.col("v"), "s").collect() == [] and ordered.run_starts(none, ["k"], ["o"], "v").collect() == []
    assert ordered.shift(none, [], ["o"], F.col("v"), 1, "s").collect() == [] and ordered.dictionary(none, "v").collect() == []
    assert {(r["lower"], r["upper"]) for r in ordered.bounds(none.select("o"), df.select("o"), ["o"]).collect()} == {(0, 0)}


@pytest.mark.parametrize("parts", [None, 6])
def test_bounds(spark, parts):
    keys, probes = [R.choice([None, R.randint(0, 20), 7]) for _ in range(80)], [None, -1, 7, 7, 21, *range(0, 21, 2)]
    k, p = spark.createDataFrame([(x, "p") for x in keys], "x int, other string"), spark.createDataFrame([(x, i) for i, x in enumerate(probes)], "x int, i int")
    known = sorted(x for x in keys if x is not None)
    for down in (False, True):
        out = {r["i"]: (r["x"], r["lower"], r["upper"]) for r in ordered.bounds(k, p, ["x"], down, parts=parts).collect()}
        for i, x in enumerate(probes):
            lo, hi = (None, None) if x is None else (bisect_left(known, x), bisect_right(known, x))
            assert out[i] == (x, lo, hi) if not down or x is None else out[i] == (x, len(known) - hi, len(known) - lo)


def test_bounds_of_several_columns(spark):
    keys = [(R.randint(0, 4), R.choice("abc")) for _ in range(60)] + [(None, "a"), (1, None)]
    df = spark.createDataFrame(keys, "x int, y string")
    probes = spark.createDataFrame([(x, y) for x in range(-1, 6) for y in "abcd"], "x int, y string")
    order = lambda t: (-t[0], t[1])
    known = sorted(order(t) for t in keys if None not in t)
    for r in ordered.bounds(df, probes, ["x", "y"], [True, False]).collect():
        at = order((r["x"], r["y"]))
        assert (r["lower"], r["upper"]) == (bisect_left(known, at), bisect_right(known, at))


def test_dictionaries(spark):
    a, b = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string"), spark.createDataFrame([("c",), ("b",)], "v string")
    first, second = ordered.dictionary(a, "v"), ordered.dictionary(b, "v", 5)
    assert sorted(map(tuple, first.collect())) == [("a", 0), ("b", 1)]
    assert sorted(map(tuple, ordered.dictionary_merge(first, second).collect())) == [("a", 0, 0, None), ("b", 1, 1, 0), ("c", 2, None, 1)]
    assert sorted(map(str, ordered.dictionary_lookup(b.union(a), "v", first).collect())) == sorted(map(str, spark.createDataFrame([("c", None), ("b", 1), ("b", 1), ("a", 0), ("b", 1), (None, None)], "v string, code long").collect()))
    inverse = ordered.unique_inverse(a.withColumn("i", F.monotonically_increasing_id()), "v", "i")
    assert sorted(r["code"] for r in inverse.collect()) == [0, 1, 1]
