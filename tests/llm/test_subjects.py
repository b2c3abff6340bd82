import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import subjects
from brindle.llm.subjects import Rows, Vocabulary, classify, distinct, features, fit, gradient, sections, words

TERMS = {"sport": ["goalkeeper", "penalty", "stadium", "referee", "hurdles"], "food": ["sourdough", "vinegar", "dumplings", "seasoning", "custard"], "law": ["verdict", "notary", "easement", "plaintiff", "statute"]}
PLAIN = "the account of this and that was found in an early list where others held it little known for years".split()


def section(r, area, n=60):
    return " ".join(r.choice(TERMS[area]) if r.random() < 0.3 else r.choice(PLAIN) for _ in range(n))


def corpus(n, seed):
    r, rows, truth = random.Random(seed), [], []
    for i in range(n):
        areas = r.sample(sorted(TERMS), r.choice([0, 1, 1, 2]))
        if not areas:
            text = r.choice(["#REDIRECT [[Elsewhere]]", " ".join(r.choice(PLAIN) for _ in range(80)), "asdf !!!!", None, "", "  "])
        else:
            text = "\n\n== Part ==\n\n".join(section(r, a) for a in [areas[0], *areas])
        rows.append((i, text, "x"))
        truth.append(set(areas))
    return rows, truth


def test_sections():
    assert sections("Caf&eacute; sof­t\n== Head ==\nB​read <ref>no</ref> https://x.example/y z1") == [["café", "soft"], ["bread"]]
    assert sections("crÃ¨me") == [["crème"]] and sections(None) == [] and sections("") == []
    assert features("ab") == ["ab"] and features("abcde") == ["abcde", "#<abcd", "#abcde", "#bcde>"]


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    x = Rows(np.array([0, 3, 3, 5]), np.array([0, 2, 3, 1, 3]), rng.random(5).astype(np.float32))
    part = {"start": x.start, "ids": x.ids, "weight": x.weight, "target": np.array([[1, 0], [0, 0], [1, 1]], np.float32)}
    w = [rng.normal(size=s) for s in ((4, 3), (3, 2), (2,))]

    def loss():
        z = x.mean(w[0]).astype(float) @ w[1] + w[2]
        return float((np.log1p(np.exp(z)) - part["target"] * z).sum())

    for a, g in zip(w, gradient(part, w)):
        for i in np.ndindex(*a.shape):
            a[i] += 1e-3
            up = loss()
            a[i] -= 2e-3
            down = loss()
            a[i] += 1e-3
            assert abs((up - down) / 2e-3 - g[i]) < 2e-2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=40))
def test_words_of_ascii_lines(line):
    assert words(line) is None or words(line) == subjects._WORD.findall(subjects._ADDRESS.sub(" ", line).lower())


def test_distinct():
    rng, place = np.random.default_rng(1), np.zeros(50, np.int32)
    for n in (0, 1, 7, 400):
        x = rng.integers(0, 50, n).astype(np.int32)
        assert sorted(distinct(x, place)) == sorted(set(x.tolist()))


def test_rows_of_a_vocabulary():
    v = Vocabulary(["mug", "tea"], np.array([1.0, 2.0]))
    x, owner = v.rows(["mug mug tea", None, "none\n== H ==\ntea"], True)
    assert owner.tolist() == [0, 2, 2] and np.diff(x.start).tolist() == [2, 0, 1] and x.ids.tolist() == [0, 1, 1]


@pytest.fixture(scope="module")
def model(spark):
    rows, truth = corpus(400, 1)
    docs = spark.createDataFrame(rows, "doc int, text string, subject string")
    r = random.Random(7)
    labels = [(i, a if r.random() > 0.05 else "food") for i, t in enumerate(truth) for a in (t or {None})] + [(0, "unknown area"), (None, "law")]
    return fit(docs, spark.createDataFrame(labels, "doc int, label string"), sorted(TERMS), "doc", "text", "label", max_share=0.6)


def test_held_out(spark, model):
    rows, truth = corpus(300, 2)
    docs = spark.createDataFrame(rows, "doc int, text string, subject string").repartition(3)
    out = classify(docs, model, "text", ["doc", "subject"])
    assert out.columns == ["doc", "subject", "subject_", "score"]
    found = {(r["doc"], r["subject_"]) for r in out.collect()}
    want = {(i, a) for i, t in enumerate(truth) for a in t}
    hit = len(found & want)
    assert hit / len(found) > 0.95 and hit / len(want) > 0.95


def test_partitions_do_not_matter(spark):
    rows, truth = corpus(120, 3)
    docs = spark.createDataFrame(rows, "doc int, text string, subject string")
    labels = spark.createDataFrame([(i, a) for i, t in enumerate(truth) for a in (t or {None})], "doc int, label string")
    a, b = (fit(docs, labels, sorted(TERMS), "doc", "text", "label", part=p, rounds=5) for p in (1, 4))
    assert a.names == b.names and all(np.allclose(x, y, atol=1e-3) for x, y in zip(a.weights, b.weights))


def test_nothing_to_learn_or_score(spark, model):
    docs = spark.createDataFrame([(1, None), (2, "text")], "doc int, text string")
    nothing = fit(docs, spark.createDataFrame([], "doc int, label string"), ["law"], "doc", "text", "label")
    assert nothing.names == [] and classify(docs, nothing, "text", ["doc"]).collect() == []
    assert classify(docs.where("false"), model, "text", ["doc"]).collect() == []


def test_very_long_text(spark, model):
    text = " ".join(PLAIN) * 20_000 + "\n== End ==\n" + section(random.Random(1), "law")
    assert [r["subject"] for r in classify(spark.createDataFrame([(1, text)], "doc int, text string"), model, "text", ["doc"]).collect()] == ["law"]


def test_the_sample_is_bounded(spark):
    rows, truth = corpus(100, 4)
    docs = spark.createDataFrame(rows, "doc int, text string, subject string")
    labels = spark.createDataFrame([(i, a) for i, t in enumerate(truth) for a in (t or {None})], "doc int, label string")
    m = fit(docs, labels, sorted(TERMS), "doc", "text", "label", most_labelled=60, most_features=20, rounds=2)
    assert 0 < (m.rarity > 0).sum() <= 20 and subjects.MOST_LABELLED == 20_000


def test_rare_features_are_kept(spark):
    words = ["".join(p) for p in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 18_000)]
    texts = [" ".join(words)] * 2 + [" ".join(PLAIN)] * 18
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    labels = spark.createDataFrame([(i, "law" if i < 2 else None) for i in range(20)], "doc int, label string")
    assert set(words) <= set(fit(docs, labels, ["law"], "doc", "text", "label", rounds=1).names)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\v", "\f", "\x85", "\u2028", "\u2029", "&#13;&#10;"])
def test_sections_at_any_line_end(end):
    assert sections(end.join(["red tea", "== Head ==", "blue mug", "=== Sub === ", "end"])) == [["red", "tea"], ["blue", "mug"], ["end"]]


def test_rarity_is_counted_over_all_documents(spark):
    texts = ["tea mug"] * 2 + ["mug"] * 8 + ["tea cup"] * 3 + ["cup"] * 7 + [None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").repartition(3)
    labels = spark.createDataFrame([(i, "law" if i < 2 else None) for i in range(10)], "doc int, label string")
    m = fit(docs, labels, ["law"], "doc", "text", "label", rounds=1, max_share=0.4)
    assert m.names == ["mug", "tea"] and np.allclose(m.rarity, [0, np.log(20 / 5)])  # mug is in half of all; cup is in no labelled text
