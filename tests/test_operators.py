import operator
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import joins, sets


#: The two tables of thirteen rows with nulls that the known answers below belong to.
def nums(spark):
    return spark.sql("SELECT * FROM VALUES (3, 4, 5, 1), (NULL, NULL, 4, 2), (20, NULL, NULL, 3), (1, 2, 8, NULL), (4, 5, NULL, 4), (NULL, 5, 2, 8), (NULL, NULL, 4, NULL), (2, NULL, 2, 9), (2, 3, 4, 11), (52, 6, NULL, 23), (4, NULL, 2, 42), (NULL, 3, 1, 50), (2, NULL, NULL, 12) AS t(a, b, c, d)")


def nums2(spark):
    return spark.sql("SELECT * FROM VALUES (3, NULL), (NULL, NULL), (20, 32), (1, 41), (NULL, 5.0), (NULL, 5.4), (2, 44), (42, 15), (12, 13), (52, 61), (4, NULL), (NULL, 34), (2, NULL) AS t(x, y)")


def test_known_answers(spark):
    r = nums(spark).selectExpr("sum(a) s", "sum(d) d", "avg(a) m", "count(*) n", "sum(b - a) t", "max(a) hi", "min(b) lo", "round(corr(a, b), 4) r").first()
    assert tuple(r) == (90, 165, 10.0, 13, -42, 52, 2, 0.7419)
    assert nums(spark).where("coalesce(c + d, 25) > 24").count() == 8
    assert nums(spark).join(nums2(spark), F.col("a") == F.col("x")).count() == 12
    assert nums(spark).join(nums2(spark), F.col("b") == F.col("y"), "left").count() == 13
    assert nums(spark).join(nums2(spark), F.col("b") == F.col("y"), "right").count() == 14


def test_star_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (None, "w")], "k int, r string")
    assert joins.star_join(left, right, "k").collect()[0]["r"] == "x"
    assert joins.star_join(left, right, "k", "left").count() == 3
    twice = right.union(right.where("k = 1"))
    with pytest.raises(Exception, match="right key is not unique: 1"):
        joins.star_join(left, twice, "k").collect()


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_inequality(spark, op):
    a, b = [1, 2, 3, None], [2, 3, None, 2]
    l, r = spark.createDataFrame([(x,) for x in a], "x int"), spark.createDataFrame([(x,) for x in b], "y int")
    want = sorted((x, y) for x in a for y in b if x and y and eval(f"{x} {op} {y}"))
    assert sorted(map(tuple, joins.inequality_join(l, r, "x", op, "y").collect())) == want


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_inequality_of_two_large_sides(spark, op):
    """By ranges of the right side, with a hot value, nulls and NaN; and the numbers of pairs by sorted search."""
    r = random.Random(1)
    pool = [r.choice([1.5, 1.5, r.uniform(-5, 5), None]) for _ in range(300)]
    a, b = pool[:120] + [float("inf")], pool[120:] + [float("-inf")]
    left, right = spark.createDataFrame([(i, x) for i, x in enumerate(a)], "i int, x double"), spark.createDataFrame([(j, y) for j, y in enumerate(b)], "j int, y double")
    f = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if None not in (x, y) and f(x, y))
    out = joins.inequality_join(left, right, "x", op, "y", most=0, range_rows=20)
    assert sorted(map(tuple, out.select("i", "j").collect())) == want
    counts = joins.inequality_counts(left, right, "x", op, "y")
    assert counts.columns == ["i", "x", "n"] and {r["i"]: r["n"] for r in counts.collect()} == {i: sum(k == i for k, _ in want) for i in range(len(a))}


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 63, 64, 65, 1000])
def test_ranges_of_values(spark, n):
    """A value's range is the number of cuts below it, however many there are; NaN is above all."""
    cuts, xs = [i / 2 for i in range(n)], [-1.0, 0.0, 0.1, 15.4, 15.5, 15.6, 16.0, 16.1, 31.5, 31.6, 499.5, 1e9, float("nan")]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(joins._place(F.col("x"), cuts).alias("r")).collect()
    assert [r["r"] for r in got] == [n if x != x else sum(x > c for c in cuts) for x in xs]


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_pairs_in_packs(spark, op):
    """Aggregates of all pairs without the pairs: a hot value of the right is one row, and ranges beyond are one."""
    r, nan = random.Random(3), float("nan")
    a = [r.choice([1.5, nan, None, r.uniform(-6, 6)]) for _ in range(60)] + [float("inf"), -9.0]
    b = [r.choice([1.5, 1.5, 1.5, nan, None, r.uniform(-5, 5)]) for _ in range(400)]
    left, right = spark.createDataFrame([(i // 2, x) for i, x in enumerate(a)], "i int, x double"), spark.createDataFrame([(j, y) for j, y in enumerate(b)], "j int, y double")
    f = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    rank = lambda x: (x != x, 0 if x != x else x)
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if None not in (x, y) and f(rank(x), rank(y)):
                n, low = want.get(i // 2, (0, j))
                want[i // 2] = (n + 1, min(low, j))
    parts = {"n": (F.count(F.lit(1)), F.sum), "low": (F.min("j"), F.min)}
    for rows in (20, 1000):
        packs = joins.inequality_packs(left, right, "x", op, "y", parts, range_rows=rows)
        assert packs.columns == ["i", "x", "n", "low"]
        assert {k: (n, low) for k, n, low in packs.groupBy("i").agg(F.sum("n"), F.min("low")).collect()} == want
        assert packs.count() < sum(n for n, _ in want.values()) / (5 if rows == 20 else 2)
    assert joins.inequality_packs(left, right.where("false"), "x", op, "y", parts).count() == 0
    with pytest.raises(ValueError):
        joins.inequality_packs(left, right, "x", "=", "y", parts)


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_copies_of_the_left_are_not_broadcast(spark, op):
    """The left side looks small, as its estimate leaves out its copies by range; their number has no bound."""
    left, right = spark.range(0, 300, 7).withColumnRenamed("id", "x"), spark.range(100_000, 0, -1).selectExpr("id % 300 AS y", "repeat('z', 40) AS z")
    out = joins.inequality_join(left, right, "x", op, "y", most=0, range_rows=1000)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    f = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    assert out.count() == sum(f(x, y % 300) for x in range(0, 300, 7) for y in range(1, 100_001))


def test_sizes_are_measured(spark):
    df = spark.range(1000).selectExpr("id", "repeat('x', 1000) AS t", "array(id, id) AS a")
    assert 1_000_000 < joins.measured_bytes(df) < 1_100_000
    assert joins.is_small(df) and not joins.is_small(df, 500_000)
    assert joins.measured_bytes(df.where("false")) == 0


def test_band_join(spark):
    points = [(k, x) for k in "ab" for x in (-7.5, 0.0, 3.0, 10.0, 25.0, None)]
    spans = [(k, lo, hi) for k in "ac" for lo, hi in ((-8.0, 3.0), (3.0, 26.0), (5.0, 4.0), (None, 1.0))]
    l, r = spark.createDataFrame(points, "k string, x double"), spark.createDataFrame(spans, "k string, lo double, hi double")
    want = sorted((k, x, lo, hi) for k, x in points for j, lo, hi in spans if k == j and None not in (x, lo) and lo <= x <= hi)
    assert sorted(map(tuple, joins.band_join(l, r, "x", "lo", "hi", 4.0, ["k"]).select("k", "x", "lo", "hi").collect())) == want


def test_wide_intervals(spark):
    """Intervals of any width, infinite ones too, touch a bounded number of buckets."""
    inf, r = float("inf"), random.Random(2)
    points = [r.uniform(-1e6, 1e6) for _ in range(200)] + [inf, -inf, 1e300, float("nan"), None]
    spans = [(-inf, inf), (0.0, 1e9), (-1e300, 5.0), (3.0, 3.0), (float("nan"), 1.0)] + [(x, x + 10 ** r.uniform(-3, 7)) for x in (r.uniform(-1e6, 1e6) for _ in range(100))]
    l, s = spark.createDataFrame(enumerate(points), "i long, x double"), spark.createDataFrame([(j, *x) for j, x in enumerate(spans)], "j int, lo double, hi double")
    want = sorted((i, j) for i, x in enumerate(points) for j, (lo, hi) in enumerate(spans) if x is not None and lo <= x <= hi)
    assert sorted(map(tuple, joins.band_join(l, s, "x", "lo", "hi", 1.0).select("i", "j").collect())) == want


def test_sets(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "v string, i int")
    assert not sets.is_unique(df, "v").first()[0] and sets.is_unique(df, "i").first()[0] and sets.is_unique(df.where("false"), "v").first()[0]
    assert sorted(map(tuple, sets.unique_index(df.where("v is not null"), "v", "i").collect())) == [("a", 2, 1), ("b", 1, 2)]
    merged = sets.merge_sorted([df.where("i < 3"), df.where("i > 2"), df.where("i = 1")], ["v"], True, "t")
    assert [tuple(r) for r in merged.collect()] == [("b", 1, 0), ("b", 3, 1), ("b", 1, 2), ("a", 2, 0), (None, 4, 1)]
    assert [r["i"] for r in sets.merge_sorted([df, df], ["v", "i"]).collect()] == [4, 4, 2, 2, 1, 1, 3, 3]


def test_misses(spark):
    l, r = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert joins.lookup_misses(l, r, "k").count() == 2
