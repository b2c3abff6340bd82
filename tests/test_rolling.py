import math
import random
from collections import defaultdict

import pytest

from brindle.operators.rolling import trailing_extremes, trailing_totals


def brute(rows, periods):
    day = defaultdict(lambda: defaultdict(float))
    for e, d, v, *_ in rows:
        if None not in (e, d, v):
            day[e][d] += v
    out = {}
    for e, days in day.items():
        for d in range(min(days), max(days) + 1):
            out[e, d] = [days.get(d, 0.0)] + [sum(days.get(x, 0.0) for x in range(d - p + 1, d + 1)) for p in periods]
    return out


def sample(seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 2, 2, 3, None]), r.choice([r.randint(-50, 400), None]), r.choice([r.randint(-500, 900), None])) for _ in range(300)]
    return rows + [(9, 5, 100), (10, 0, 1), (10, 3000, 2), (10, 3000, 2)]  # one day only; years of silence; repeated rows


@pytest.mark.parametrize("tile, block", [(128, 1024), (8, 2), (7, 1)])
def test_totals(spark, tile, block):
    rows = sample(tile)
    df = spark.createDataFrame(rows, "who int, day int, v long")
    out = trailing_totals(df, "who", "day", "v", [30, 7], tile, block)
    assert out.columns == ["who", "day", "total", "total_7", "avg_7", "total_30", "avg_30"]
    got = {(r["who"], r["day"]): [r["total"], r["total_7"], r["total_30"]] for r in out.collect()}
    assert got == brute(rows, [7, 30])
    assert all(abs(r["avg_7"] * 7 - r["total_7"]) < 1e-6 for r in out.collect())


@pytest.mark.parametrize("tile", [128, 9])
def test_extremes(spark, tile):
    rows = sample(3)
    full = brute(rows, [7, 30])
    want = {}
    for e in {k[0] for k in full}:
        days = [d for x, d in full if x == e]
        for i, p in ((1, 7), (2, 30)):
            ok = [d for d in days if d >= min(days) + p - 1]
            if ok:
                want[e, p] = (max(ok, key=lambda d: (full[e, d][i], -d)), min(ok, key=lambda d: (full[e, d][i], d)))
    df = spark.createDataFrame(rows, "who int, day int, v long")
    got = {(r["who"], r["period"]): (r["high_day"], r["low_day"]) for r in trailing_extremes(df, "who", "day", "v", [7, 30], tile).collect()}
    assert got == want


def test_names_and_empty(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "x")], "total int, day int, value double, entity string")
    assert trailing_totals(df, "total", "day", "value", [7]).columns[0] == "total_"
    assert trailing_totals(df.where("false"), "total", "day", "value", [7]).collect() == []
    assert trailing_extremes(df, "total", "day", "value", [7]).collect() == []
    with pytest.raises(ValueError):
        trailing_totals(df, "total", "day", "value", [0])


@pytest.mark.parametrize("tile", [128, 10])
def test_nan_and_infinities(spark, tile):
    """They reach the totals of their own periods only."""
    inf, r = math.inf, random.Random(5)
    rows = [(e, d, float(r.randint(-9, 9))) for e in (1, 2, 3) for d in range(101)]
    rows += [(1, 40, math.nan), (2, 10, inf), (2, 60, -inf), (2, 63, inf), (3, 0, -inf), (3, 100, 1e308), (3, 99, 1e308)]
    df = spark.createDataFrame(rows, "who int, day int, v double")
    got = {(x["who"], x["day"]): [x["total"], x["total_7"], x["total_30"]] for x in trailing_totals(df, "who", "day", "v", [7, 30], tile).collect()}
    want = brute(rows, [7, 30])
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all(g == x or math.isnan(g) and math.isnan(x) for g, x in zip(got[k], w)), k
    assert sum(math.isnan(v[1]) for k, v in got.items() if k[0] == 1) == 7
    ext = {(x["who"], x["period"]): x for x in trailing_extremes(df, "who", "day", "v", [7, 30], tile).collect()}
    for (e, p), x in ext.items():
        days = [d for d in range(p - 1, 101) if not math.isnan(want[e, d][1 if p == 7 else 2])]
        total = lambda d: want[e, d][1 if p == 7 else 2]  # noqa: B023, E731
        assert x["high_day"] == max(days, key=lambda d: (total(d), -d)) and x["low_day"] == min(days, key=lambda d: (total(d), d))
    assert len(ext) == 6


def test_large_whole_numbers(spark):
    rows = [(1, 0, 2**62 - 1), (1, 1, 2**62), (1, 2, -(2**61) - 3), (1, 3, 1), (2, 0, -(2**63)), (2, 9, 2**53 + 1), (2, 10, 1)]
    df = spark.createDataFrame(rows, "who int, day int, v long")
    out = trailing_totals(df, "who", "day", "v", [2, 3])
    assert dict(out.dtypes)["total_2"] == "bigint"
    day = {(e, d): v for e, d, v in rows}
    for x in out.collect():
        for p in (2, 3):
            assert x[f"total_{p}"] == sum(day.get((x["who"], d), 0) for d in range(x["day"] - p + 1, x["day"] + 1))
    low = [x for x in trailing_extremes(df, "who", "day", "v", [1]).collect() if x["who"] == 2][0]
    assert (low["low"], low["low_day"], low["high"], low["high_day"]) == (-(2**63), 0, 2**53 + 1, 9)
    with pytest.raises(Exception, match="64 bits"):
        trailing_totals(spark.createDataFrame([(1, 0, 2**62), (1, 1, 2**62)], "who int, day int, v long"), "who", "day", "v", [2]).collect()
