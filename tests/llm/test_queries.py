from collections import Counter
from itertools import combinations

import pytest

from brindle.llm import queries
from brindle.operators.packed import split_packed


@pytest.fixture(scope="module")
def done(spark, data):
    return {k: q(spark, data).toPandas() for k, q in queries.QUERIES.items()}


def test_columns(done):
    assert {k: list(v.columns) for k, v in done.items() if k.endswith("found") or k == "p5_ids"} == {"p3_found": ["item_a", "item_b"], "p5_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "subject"]}


def test_every_document_has_ids(spark, data, done):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()
    assert sorted(done["p5_ids"].doc_id) == sorted(texts.doc_id)
    sizes = done["p5_ids"].set_index("doc_id").ids.map(len)
    assert all((sizes[i] == 0) == (not t) for i, t in zip(texts.doc_id, texts.text))
    packed = done["p6_pack"]
    assert packed.groupby("doc_id")["size"].sum().to_dict() == sizes[sizes > 0].to_dict()
    assert packed.groupby("container")["size"].sum().max() <= 2048


def test_pairs_are_all_pairs(spark, data, done):
    """Counted again from the values of p1_found."""
    goods = split_packed(spark.read.parquet(f"{data}/shop_orders.parquet"), "items", [], key="id").toPandas()
    baskets = goods.item.map(lambda x: " ".join(x.lower().split())).groupby(goods.id).agg(set)
    single, both = Counter(x for b in baskets for x in b), Counter(p for b in baskets for p in combinations(sorted(b), 2))
    pairs = done["p3_pairs"]
    assert {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n) for r in pairs.itertuples()} == {(a, b): (single[a], single[b], n, len(baskets)) for (a, b), n in both.items()}
    strong = pairs[(pairs.n_ab >= 5) & (2000 * pairs.n_ab >= pairs.n) & (pairs.n_ab * pairs.n >= 3 * pairs.n_a * pairs.n_b)]
    assert set(zip(strong.item_a, strong.item_b)) == set(zip(done["p3_found"].item_a, done["p3_found"].item_b))


def test_areas_are_areas(spark, data, done):
    areas = {r[0] for r in spark.read.parquet(f"{data}/subject_areas.parquet").select("subject").collect()}
    assert set(done["p7_found"].subject) <= areas and not done["p7_found"].duplicated().any()
