import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import cooccurrence
from brindle.llm.cooccurrence import Gram, Named, every_pair, pair_counts


def lists(records):
    return np.concatenate(records), np.array([len(r) for r in records])


@pytest.mark.parametrize("head, held", [(2048, 1 << 21), (512, 1000), (0, 50)])
@pytest.mark.parametrize("longest", [4, 60, 400])
def test_gram(longest, head, held):
    rng = np.random.default_rng(longest)
    records = [np.sort(rng.choice(600, rng.integers(0, longest), replace=False)).astype(np.int32) for _ in range(300)]
    x = np.zeros((300, 600))
    for i, r in enumerate(records):
        x[i, r] = 1
    g, out = Gram(head=head, held=held), np.zeros((600, 600))
    for part in (records[:100], records[100:]):
        for code, n in g.add(*lists(part)):
            out[code >> 32, code & 0xFFFFFFFF] += n
        assert len(g.codes) + g.n_fresh <= 2 * held + 600
    for code, n in g.flush():
        out[code >> 32, code & 0xFFFFFFFF] += n
    assert (out == np.triu(x.T @ x, 1)).all()


def test_sums_of_many_items_combine():
    """A million baskets of 3 of 6,000 items with a power law: a tenth of the pairs at most leaves the task, in bounded memory."""
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 6001) ** 1.6
    g, rows, pairs = Gram(held=1 << 17), 0, 0
    for _ in range(50):
        x = np.sort(rng.choice(6000, (20_000, 3), p=share / share.sum()), axis=1)
        x = x[(np.diff(x, axis=1) > 0).all(axis=1)]
        pairs += 3 * len(x)
        rows += sum(len(c) for c, _ in g.add(x.ravel(), np.full(len(x), 3)))
        assert len(g.codes) + g.n_fresh <= 3 << 17 and len(g.blocks) <= 36
    rows += sum(len(c) for c, _ in g.flush())
    assert rows * 10 <= pairs


def brute(baskets, least, share):
    sets = [{x for x in b or [] if x is not None} for b in baskets]
    sets = [s for s in sets if s]
    single, pairs, n = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(sorted(s), 2)), len(sets)
    return {(a, b, single[a], single[b], k, n) for (a, b), k in pairs.items() if k >= least and k * share >= n}


@pytest.mark.parametrize("most_items", [1 << 18, 3])
def test_against_brute_force(spark, most_items):
    r = random.Random(2)
    goods = [f"g{i}" for i in range(40)] + ["é", "Z", "￿", "😀"]
    baskets = [[r.choice(goods[: r.choice([3, 44])]) for _ in range(r.choice([0, 1, 3, 40]))] for _ in range(400)] + [None, [None], [None, "é", "é"], ["é"]]
    df = spark.createDataFrame([(b, "x") for b in baskets], "b array<string>, items string").repartition(3)
    out = pair_counts(df, "b", 5, 50, most_items)
    assert {tuple(x)[:6] for x in out.collect()} == brute(baskets, 5, 50)
    x = out.orderBy("item_a", "item_b").first()
    assert abs(x["lift"] - x["n_ab"] * x["n"] / (x["n_a"] * x["n_b"])) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "b array<string>")
    assert pair_counts(df, "b", 1, 10).collect() == []
    assert pair_counts(df.where("false"), "b", 1, 10).collect() == []


def test_every_pair_against_brute_force(spark):
    r = random.Random(3)
    goods = [f"g{i}" for i in range(400)] + ["é", "Z", "￿", "😀"]
    baskets = [[r.choice(goods[: r.choice([3, 404])]) for _ in range(r.choice([0, 1, 2, 5, 40]))] for _ in range(300)] + [goods, None, [None], [None, "é", "é"]]
    out = every_pair(spark.createDataFrame([(b,) for b in baskets], "b array<string>").repartition(3), "b").collect()
    assert len(out) == len({tuple(x)[:2] for x in out}) and {tuple(x)[:6] for x in out} == brute(baskets, 1, 1 << 40)
    assert all(abs(x["lift"] - x["n_ab"] * x["n"] / (x["n_a"] * x["n_b"])) < 1e-9 for x in out)


def test_every_pair_of_nothing(spark):
    assert every_pair(spark.createDataFrame([(None,), (["a"],)], "b array<string>"), "b").collect() == []


@pytest.mark.parametrize("held", [1 << 21, 200, 2])
def test_pairs_are_passed_on(monkeypatch, held):
    monkeypatch.setattr(cooccurrence, "OUT", 7)
    r = random.Random(4)
    baskets = [r.sample([f"g{i}" for i in range(60)] + ["é", "￿", "😀"], r.choice([0, 1, 2, 5, 40])) for _ in range(90)]
    named, out = Named(held), Counter()
    named.gram.head = 8
    for b in [*(b for lo in range(0, 90, 9) for b in named.add(pa.array(baskets[lo : lo + 9], pa.list_(pa.string())))), *named.flush()]:
        for x in b.to_pylist():
            out[x["item_a"], x["item_b"]] += x["n"]
    assert out == Counter(p for b in baskets for p in combinations(sorted(b), 2)) and not named.number
