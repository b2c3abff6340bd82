import base64
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe

FILE = Path(bpe.TOKENIZERS, bpe.VOCABULARY)
if not FILE.exists():
    pytest.skip("the tokenizer files are not here", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def coders():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.open("rb"))}
    return bpe.Encoder(FILE.read_bytes()), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(x):
    return np.frombuffer(x, np.int32).tolist()


def texts():
    r = random.Random(5)
    letters = "abcdeghilnorstuéñüß123 .,'\n\t🎉​\xa0漢"
    out = ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 5, 30, 200]))) for _ in range(400)]
    out += ["".join(r.choice("etaoinshr") for _ in range(n)) for n in (255, 256, 257, 3000, 20_000)]
    return out + ["", " ", "  \n ", "<|endoftext|> it's", "a" * 50_000, "!?" * 700, "Ünïcödé ï̈"]


def test_same_as_the_library(coders):
    ours, theirs = coders
    for t, x in zip(texts(), ours.encode(texts())):
        assert ids(x) == theirs.encode_ordinary(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("a'sZ1 \n\t\r\x0b\x0c\x1c\x85\xa0\u2028.,_é漢"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_lines_and_their_words(coders, text):
    """The words of the lines are those of the text, by either engine."""
    ours, _ = coders
    assert "".join(bpe.lines(text)) == text
    assert [w for x in bpe.lines(text) for w in (ours.split_ascii(x) if x.isascii() else ours.split(x))] == ours.split(text)


def test_kept_lines(coders, monkeypatch):
    monkeypatch.setattr(bpe, "LINES", 30)
    monkeypatch.setattr(bpe, "TOGETHER", 20)
    some = ["one line\ntwo\n\nthree", "one line\ntwo", "other\ntwo\n", "x" * 100, "one line\n" * 50] * 3 + texts()[:100]
    ours = bpe.Encoder(FILE.read_bytes())
    assert [ids(x) for x in ours.encode(some)] == [coders[1].encode_ordinary(t) for t in some]
    assert ours.kept == sum(map(len, ours.lines))


def test_matrix_and_heap_agree(coders):
    words = [w.encode() for t in texts() for w in coders[0].split(t) if 1 < len(w.encode()) < 200]
    assert [ids(x) for x in map(coders[0].heap, words)] == [ids(x) for w in words for x in coders[0].matrix([w])]


def test_a_full_cache(coders, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    ours = bpe.Encoder(FILE.read_bytes())
    assert [ids(x) for x in ours.encode(texts())] == [coders[1].encode_ordinary(t) for t in texts()]


def test_pair_table():
    n = 5000
    left, right = np.divmod(np.random.default_rng(1).permutation(10**6)[:n].astype(np.int32), 1000)
    t = bpe.PairTable(left, right, np.arange(n, dtype=np.int32))
    assert (t.find(left, right) == np.arange(n)).all()
    assert (t.find(left + 5000, right) == bpe.NONE).all() and (t.find(-left - 1, right) == bpe.NONE).all()


def test_table(spark, coders):
    rows = [(1, t, "x") for t in ["a b", None, "", "a b", "  "]]
    df = spark.createDataFrame(rows, "ids int, text string, other string")
    out = bpe.encode(df, "text", ["ids"])
    assert out.columns == ["ids", "ids_"] and dict(out.dtypes)["ids_"] == "array<int>"
    assert [r["ids_"] for r in out.collect()] == [coders[1].encode_ordinary(t or "") for _, t, _ in rows]
    assert bpe.encode(df.where("false"), "text", ["ids"]).collect() == []
    assert [r["n_tokens"] for r in bpe.count_tokens(df, "text", ["ids"]).collect()] == [len(coders[1].encode_ordinary(t or "")) for _, t, _ in rows]
