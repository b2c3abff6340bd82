import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.packing import Plan, configurations, least_containers, pack, summary


def loads(counts, plan):
    load = np.zeros(plan.containers, np.int64)
    seen = {s: np.zeros(n, int) for s, n in counts.items()}
    for s, r0, n, c0, per in plan.runs:
        r = np.arange(r0, r0 + n)
        seen[s][r] += 1
        np.add.at(load, c0 + (r - r0) // per, s)
    assert all((v == 1).all() for v in seen.values())
    return load


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=30), st.integers(8, 40))
def test_plans_are_whole(counts, groups):
    plan = Plan(counts, 100, groups)
    load = loads(counts, plan)
    if counts:
        assert load.max() <= 100 and load.min() > 0
    total = sum(s * n for s, n in counts.items())
    assert plan.containers <= 2 * total / 100 + 1 + groups  # best fit, and a constant for the groups


def test_little_is_left_over():
    rng = np.random.default_rng(4)
    sizes, n = np.unique(np.minimum(2048, rng.lognormal(6, 1, 200_000).astype(int) + 1), return_counts=True)
    counts = dict(zip(sizes.tolist(), n.tolist()))
    plan = Plan(counts)
    assert loads(counts, plan).max() <= 2048
    assert plan.containers <= 1.01 * sum(s * n for s, n in counts.items()) / 2048


def test_configurations_reach_the_optimum():
    got, solution, bound = configurations([60, 40, 35, 25], [100, 100, 200, 100], 100)  # 60+40, 35+35+25
    assert sum(n for _, n in got) == 200 and abs(solution - 200) < 1e-6 and abs(bound - 200) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_columns_are_generated_to_the_end(seed):
    """The linear programme's solution is its optimum: nothing can be below it."""
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.choice(np.arange(256, 2048), 32, replace=False).tolist(), reverse=True)
    _, solution, bound = configurations(sizes, rng.integers(1, 10_000, 32).tolist(), 2048)
    assert abs(solution - bound) <= 1e-6 * solution


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=4))
def test_least_containers_is_a_bound(counts):
    items = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)

    def fits(left, room):
        return not left or any(left[0] <= r and fits(left[1:], sorted([*room[:i], r - left[0], *room[i + 1 :]])) for i, r in enumerate(room) if r not in room[:i])

    least = least_containers(counts, 20)
    assert least == 0 if not items else (least == 1 or not fits(items, [20] * (least - 1))) and least * 20 >= sum(items)


def test_summary(spark):
    df = spark.createDataFrame([(0, 10), (0, 10), (1, 15), (2, 15)], "container long, size long")
    r = summary(df, capacity=20).first()
    assert tuple(r)[:5] == (4, 50, 3, 3, 0) and abs(r["unused"] - 10 / 60) < 1e-9
    assert tuple(summary(df.where("false"), capacity=20).first()) == (0, 0, 0, 0, 0, None)


def test_table(spark):
    rows = [(i, s) for i, s in enumerate([5, 250, None, 0, -3, 100, 100, 60, 40, 201])] + [(0, 5), (0, 5)]
    df = spark.createDataFrame(rows, "container int, n int")
    out = pack(df, "n", ["container"], 100)
    assert out.columns == ["container", "piece", "size", "container_"]
    got = out.collect()
    load = {}
    for r in got:
        load[r["container_"]] = load.get(r["container_"], 0) + r["size"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    by = {}
    for r in got:
        by.setdefault(r["container"], []).append((r["piece"], r["size"]))
    assert sorted(by[1]) == [(0, 100), (1, 100), (2, 50)] and sorted(by[9]) == [(0, 100), (1, 100), (2, 1)]
    assert by[0] == [(0, 5)] * 3 and not {2, 3, 4} & by.keys()
    assert pack(df.where("false"), "n", ["container"], 100).collect() == []


def test_one_size_holds_most(spark):
    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 700 ELSE 1 + id % 900 END AS n")
    out = pack(df.repartition(5), "n", ["id"], 1000)
    assert out.count() == 6000 and out.select("id").distinct().count() == 6000
    sums = out.groupBy("container").sum("size").toPandas()["sum(size)"]
    alone = out.where("size > 500").count()  # no two of these share a container
    assert sums.max() <= 1000 and alone <= len(sums) < 1.05 * alone


def test_bad_capacity():
    with pytest.raises(Exception):
        Plan({200: 1}, 100)
