import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brindle.operators import packed

GOODS = ["Mug", "Beans, baked", 'Board 12" oak', "Baker's Flour", "Glue; fast set", "Half/Half Creamer", "Lamp [dimmable]", "Crème Cup", "Nuts & Seeds", "Rope 10m/6mm"]
CODER = packed.Coder({packed.fold(g): 1000 for g in GOODS}, 10_000)


def values(field, coder=CODER):
    return coder.parse(field)[1]


@pytest.mark.parametrize(
    "field, expected",
    [
        ("[Mug, Nuts & Seeds]", ["Mug", "Nuts & Seeds"]),
        ('["Mug", "Cr\\u00e8me Cup"]', ["Mug", "Crème Cup"]),
        ("['Mug', \"Baker's Flour\"]", ["Mug", "Baker's Flour"]),
        ("'Baker''s Flour';'Beans, baked'", ["Baker's Flour", "Beans, baked"]),
        ('[Mug, "Board 12"" oak"', ["Mug", 'Board 12" oak']),
        ('{Mug,"Board 12\\" oak"}', ["Mug", 'Board 12" oak']),
        ("Beans\\, baked,Mug", ["Beans, baked", "Mug"]),
        ("Beans, baked", ["Beans, baked"]),
        ("Beans, baked;Mug", ["Beans, baked", "Mug"]),
        ("Glue; fast set | Mug", ["Glue; fast set", "Mug"]),
        ("Mug,Nuts & Seeds | Crème Cup;Mug", ["Mug", "Nuts & Seeds", "Crème Cup", "Mug"]),
        ("Mug / Half/Half Creamer /", ["Mug", "Half/Half Creamer"]),
        ("Mug\r\nBeans, baked\r\n", ["Mug", "Beans, baked"]),
        ("Mug\t\tRope 10m/6mm", ["Mug", "Rope 10m/6mm"]),
        ("[Mug, Lamp [dimmable]", ["Mug", "Lamp [dimmable]"]),
        ("[Lamp [dimmable]]", ["Lamp [dimmable]"]),
        ('"[Mug, Crème Cup]"', ["Mug", "Crème Cup"]),
        ("\xa0Mug ​; ;MUG\xa0", ["Mug", "MUG"]),
        ("[, Mug,, ]", ["Mug"]),
        ("Voucher A1-2,Mug", ["Voucher A1-2", "Mug"]),
        *((x, []) for x in ["", "  ", "null", "N/A", "none", "-", "[]", "[ ]", "{}", '""', ";", "[,]"]),
    ],
)
def test_dialects(field, expected):
    assert values(field) == expected


def quoted(v, q, double):
    return q + (v.replace(q, q * 2) if double else v.replace("\\", "\\\\").replace(q, "\\" + q)) + q


DIALECTS = {
    "json": lambda vs: "[" + ", ".join(quoted(v, '"', False) for v in vs) + "]",
    "csv": lambda vs: ",".join(quoted(v, '"', True) for v in vs),
    "single": lambda vs: ";".join(quoted(v, "'", True) for v in vs),
    "tab": lambda vs: "\t".join(vs),
    "line": lambda vs: "\n".join(vs),
    "pipe": lambda vs: " | ".join(vs),
    "slash": lambda vs: " / ".join(vs),
    "braces": lambda vs: "{" + ",".join(quoted(v, '"', False) if set(v) & set(',"[;') else v for v in vs) + "}",
    "cut": lambda vs: "[" + ", ".join(quoted(v, '"', True) if set(v) & set(',";') else v for v in vs),
}


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(GOODS), min_size=1, max_size=8), st.sampled_from(sorted(DIALECTS)))
def test_round_trip(vs, dialect):
    assert values(DIALECTS[dialect](vs)) == vs


def test_hostile_fields_end():
    for field in ['"' * 5001, "'," * 5000, "\\" * 5001, "[" * 5000, '",' * 3000 + '"a', "a" * 200_000, "/ " * 5000]:
        values(field)


def test_very_long_list():
    assert values(";".join(["Mug"] * 50_000)) == ["Mug"] * 50_000


ROWS = [(1, "[Mug, Cup]", "x"), (1, "Mug;Cup", "y"), (2, None, "x"), (3, "null", None), (4, "Mug", "z"), (4, "Mug", "z"), (5, "", "q"), (None, "Cup|Mug", "n"), (6, "Beans, baked;Mug", "a"), (7, '"Beans, baked"', "b"), (8, "Beans, baked|Cup", "c")]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(ROWS, "id long, items string, pos string")


def test_every_row(orders):
    out = packed.split_packed(orders, "items", ["id", "pos"])
    assert out.columns == ["id", "pos", "pos_", "item"]  # a kept column keeps its name
    got = sorted((r["id"] or 0, r["pos"], r["pos_"], r["item"]) for r in out.collect())
    assert got == sorted([(1, "x", 1, "Mug"), (1, "x", 2, "Cup"), (1, "y", 1, "Mug"), (1, "y", 2, "Cup"), (4, "z", 1, "Mug"), (4, "z", 1, "Mug"), (0, "n", 1, "Cup"), (0, "n", 2, "Mug"), (6, "a", 1, "Beans, baked"), (6, "a", 2, "Mug"), (7, "b", 1, "Beans, baked"), (8, "c", 1, "Beans, baked"), (8, "c", 2, "Cup")])
    assert dict(out.dtypes)["pos_"] == "int"


def test_once_per_key(orders):
    out = packed.split_packed(orders, "items", [], key="id")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "Mug"), (1, 2, "Cup"), (4, 1, "Mug"), (6, 1, "Beans, baked"), (6, 2, "Mug"), (7, 1, "Beans, baked"), (8, 1, "Beans, baked"), (8, 2, "Cup")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, items string")
    assert packed.split_packed(empty, "items", [], key="id").collect() == []
    assert packed.split_packed(empty, "items", ["id"]).collect() == []


def test_a_hot_key_counts_once(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "CASE WHEN id % 2 = 0 THEN 'a;b' ELSE '[a, b]' END AS items")
    out = packed.split_packed(df, "items", [], key="id")
    assert out.where("id = 7").count() == 2
    assert out.count() == 2 * df.select("id").distinct().count()


def test_codes_are_bounded(spark):
    df = spark.range(2000).selectExpr("concat('v', id, ';common') AS items")
    counts, total = packed.value_codes(df, "items", max_codes=100)
    assert total == 4000 and counts == {"common": 2000}


def test_many_goods(spark):
    """More goods than codes that fit into the table for all tasks, all equally frequent: every field is split."""
    df = spark.range(500_000).selectExpr("id", "concat('good ', id, ';good ', (id + 1) % 500000, ';good ', (id + 2) % 500000) AS items")
    out = packed.split_packed(df, "items", ["id"])
    r = out.selectExpr("count(*) n", "count(DISTINCT item) d", "max(pos) p").first()
    assert tuple(r) == (1_500_000, 500_000, 3)
    assert out.where("item <> concat('good ', (id + pos - 1) % 500000)").count() == 0


@pytest.mark.parametrize("mark", ["|", "~", "::", "//", "§"])
def test_rare_goods_only(spark, mark):
    """Goods that occur once each, by marks that are known and by marks that are told."""
    rows = [(i, mark.join([f"tool {i}", f"part {i * 7}", f"spare no {i}"])) for i in range(3000)]
    out = packed.split_packed(spark.createDataFrame(rows, "id long, items string"), "items", ["id"], delimiters=["//", "§", *packed.DELIMITERS])
    assert out.count() == 9000 and out.where("pos = 3 AND item <> concat('spare no ', id)").count() == 0


def test_quotes_that_belong_to_a_value():
    coder = packed.Coder({packed.fold(g): 1000 for g in [*GOODS, "'Tea, Mix of the 80s'", "'Tea", "Mix of the 80s'", "C:\\temp"]}, 14_000)
    assert values("'Tea, Mix of the 80s'", coder) == ["'Tea, Mix of the 80s'"]  # one code is shorter than two
    coder = packed.Coder({packed.fold(g): 1000 for g in [*GOODS, "'Tea", "Mix of the 80s'"]}, 12_000)
    assert values("'Tea, Mix of the 80s'", coder) == ["'Tea", "Mix of the 80s'"]
    coder = packed.Coder({packed.fold(g): 1000 for g in [*GOODS, "Tea, Mix of the 80s"]}, 11_000)
    assert values("'Tea, Mix of the 80s'", coder) == ["Tea, Mix of the 80s"]
    coder = packed.Coder({packed.fold(g): 1000 for g in [*GOODS, "C:\\temp"]}, 11_000)
    assert values("Mug,C:\\temp", coder) == ["Mug", "C:\\temp"] and values("Mug,Beans\\, baked", coder) == ["Mug", "Beans, baked"]


FIELDS = st.one_of(
    st.builds(lambda vs, d: DIALECTS[d](vs), st.lists(st.sampled_from([*GOODS, "x1", "x2;y", ""]), max_size=5), st.sampled_from(sorted(DIALECTS))),
    st.text(alphabet="aM ug,;|/\n\t\"'[](){}\\é~:", max_size=14),
    st.sampled_from(["null", " - ", '"N/A"', "[none]", "", "Beans, baked", '"Beans, baked"', "  [Mug]", "['Mug','x1']"]),
)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(FIELDS, min_size=1, max_size=30), st.booleans())
def test_batches_are_read_as_single_fields(fields, partial):
    learned = packed.Counts.of({packed.fold(g): 5 for g in GOODS}, 60)
    if partial:
        learned.rest = 4
    one, many = packed.Coder(learned), packed.Coder(learned)
    rows, bits, text, n, still = packed._parse_batch(many, pa.array(fields, pa.string()))
    text, at, got = text.to_pylist(), 0, {}
    for r, b, k in zip(rows.tolist(), bits.tolist(), n.tolist()):
        got[r] = (b, text[at : at + k])
        at += k
    for i, f in enumerate(fields):
        want = one.parse(f)
        assert i in still.tolist() if want is None else got[i] == want, f


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(FIELDS, st.dictionaries(st.sampled_from(["mug", "x1", "x2", "y", "beans", "baked", "beans, baked", "x2;y"]), st.integers(2, 9), max_size=6))
def test_asking_is_as_good_as_knowing(field, counts):
    whole = packed.Counts({**{packed.fold(g): 50 for g in GOODS if g != "Mug"}, **counts}, 600, 20, 3, {"a": 30, "e": 20, ",": 1}, 60)
    part = packed.Counts({k: n for k, n in whole.counts.items() if n > 9}, 600, 20, 3, whole.chars, 60, rest=9)
    want, asker = packed.Coder(whole).parse(field), packed.Coder(part)
    if (got := asker.parse(field)) is None:
        told = packed.Coder(part)
        told.more = {k: counts[k] for k in asker.asked(field) if k in counts}
        got = told.parse(field)
    assert got == want


def test_asking_over_tables(spark):
    """The same values whether all codes are sent to the tasks or nearly none."""
    rows = [(i, d(vs)) for i, (vs, d) in enumerate((vs, d) for k in range(30) for d in DIALECTS.values() for vs in [[GOODS[(k + j) % 10] for j in range(1 + k % 4)]])] + [(-1, None), (-2, "x;y"), (-3, "null")]
    df = spark.createDataFrame(rows, "id long, items string")
    for key in (None, "id"):
        few, all_ = (sorted(map(tuple, packed.split_packed(df, "items", ["id"] if key is None else [], key, max_codes=m).collect())) for m in (3, 1 << 17))
        assert few == all_ and len(few) > 600


@pytest.mark.parametrize("max_codes", [1 << 17, 1])
def test_folded_values(spark, max_codes):
    df = spark.createDataFrame([(1, "MUG;  Cr\u00c8me \u00a0 Cup;mug"), (1, "Mug|Cr\u00e8me Cup|Mug"), (2, None), (3, "'A  B'")], "id int, items string")
    out = packed.once_per_key(df, "items", "id", max_codes, fold_values=True)
    assert {r["id"]: r["values"] for r in out.collect()} == {1: ["mug", "cr\u00e8me cup", "mug"], 2: [], 3: ["a b"]}


def test_the_best_row_of_a_batch():
    r = random.Random(1)
    for n in (0, 1, 50, 300):
        keys, bits = [r.choice("abcdefgh") for _ in range(n)], np.array([r.randint(0, 3) for _ in range(n)], np.int64)
        lists = [[r.choice("xy") for _ in range(r.randint(0, 2))] for _ in range(n)]
        at = packed._best_of_keys(pa.array(keys, pa.string()), bits, np.array([len(x) for x in lists], np.int64), pa.array(lists, pa.list_(pa.string())))
        rank = lambda i: (not lists[i], bits[i], lists[i])  # noqa: B023, E731
        assert {keys[i]: rank(i) for i in at} == {k: min(rank(i) for i in range(n) if keys[i] == k) for k in set(keys)} and len(at) == len(set(keys))
