import json
import operator
import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import numpy as np
import pandas as pd
import pyspark
import pytest
from pyspark.sql import functions as F

from brindle import batches, trace
from brindle.conf import HINTS, EngineConf, metrics
from brindle.functions import dates, scalar, text, vectors
from brindle.sources import tables as io
from brindle.operators import sets
from brindle.storage import free_name, materialize, release
from brindle.streaming import counts
from brindle.typed import Typed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalar(spark):
    n = F.lit(None).cast("double")
    assert one(spark, scalar.safe_divide(F.lit(1), F.lit(0))) is None
    assert one(spark, scalar.safe_mod(F.lit(-7), F.lit(3))) == -1
    assert one(spark, scalar.safe_cast(F.lit("x"), "int")) is None
    assert one(spark, scalar.safe_cast(F.lit(2.7), "int")) == 2
    assert one(spark, scalar.clip(F.lit(5), 1, 3)) == 3 and one(spark, scalar.clip(n, 1, 3)) is None
    assert one(spark, scalar.binarize(F.lit(5), 5)) == 0 and one(spark, scalar.binarize(n, 5)) is None
    assert str(one(spark, scalar.plain_zero(F.lit(-0.0)))) == "0.0"
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (None, 3.0)], "x double, y double")
    assert df.agg(scalar.safe_corr(F.col("x"), F.col("y"))).first()[0] is None


def test_text(spark):
    assert one(spark, text.split_words(F.lit(" a,b  c,"), " ,")) == ["a", "b", "c"]
    assert one(spark, text.trim_non_letters(F.lit("12 ab 3c!"))) == "ab 3c"
    assert one(spark, text.trim_non_letters(F.lit("12 ab 3"), "head")) == "ab 3"
    assert one(spark, text.hamming_distance(F.lit("karolin"), F.lit("kathrin"))) == 3
    assert one(spark, text.hamming_distance(F.lit("a"), F.lit("ab"))) is None and one(spark, text.hamming_distance(F.lit(""), F.lit(""))) == 0
    assert one(spark, text.to_number(F.lit("inf"))) == float("inf")
    assert one(spark, text.positions(F.lit("aaa"), "aa")) == [1, 2] and one(spark, text.positions(F.lit("a"), "aa")) == []


def test_dates(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, dates.months_apart(t("2024-03-01"), t("2023-12-31"))) == 3
    assert str(one(spark, dates.add(t("2024-01-31"), "month", 1)))[:10] == "2024-02-29"
    assert one(spark, dates.apart("hour", t("2024-01-02 01:30:00"), t("2024-01-01"))) == 25
    assert one(spark, dates.parse(F.lit("zz"), "yyyy")) is None


def test_vectors(spark):
    v, w = F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, vectors.dot(v, w)) == 5.0 and one(spark, vectors.norm(v)) == 3.0
    assert one(spark, vectors.axpy(2.0, v, w)) == [5.0, 4.0, 5.0]
    assert one(spark, vectors.argmax(v)) == 1 and one(spark, vectors.argmin(w)) == 1
    assert abs(one(spark, vectors.squared_deviations(v)) - 2 / 3) < 1e-9
    assert one(spark, vectors.mean(F.array().cast("array<double>"))) is None
    assert one(spark, vectors.dot(v, F.array(F.lit(1.0)))) is None


def test_typed(spark):
    r = Typed.from_range(spark, 1, 10)
    assert r.count() == 10 and r.reduce("sum") == 55 and r.reduce(min) == 1 and r.reduce("product") == 3628800
    assert r.reduce(operator.add) == 55 and r.reduce(lambda a, b: a ^ b) == 11
    assert r.filter(lambda x: x > 100).reduce("sum") is None and r.filter(lambda x: x > 100).reduce(lambda a, b: a) is None
    assert r.map(lambda x: (x, x * 2)).filter(lambda a, b: b > 16).collect() == [(9, 18), (10, 20)]
    assert r.sort_by(lambda x: x % 3, False).count() == 10
    assert Typed.from_rows(spark, [("a b",)], "v string").flat_map(lambda s: F.split(s, " ")).collect() == ["a", "b"]
    assert r.map_batches(lambda it: (pd.DataFrame({"y": b["_1"] * 2}) for b in it), "y long").reduce("sum") == 110


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\\c', None), (2, None, 2.5)], "i int, s string, d double")
    for kind, read in {"csv": io.csv, "json": io.json}.items():
        io.write(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(str, read(spark, f"{tmp_path}/{kind}", df.schema).collect())) == sorted(map(str, df.collect()))
    io.save_object(df, f"{tmp_path}/o")
    assert io.parquet(spark, f"{tmp_path}/o", {"i": "j"}).columns == ["j", "s", "d"]
    assert io.points(spark, 100).collect() == io.points(spark, 100).collect()
    assert io.numbers(spark, 5, 7).count() == 3


def test_streaming(spark, tmp_path):
    events = spark.range(400).selectExpr("id", "concat('k', id % 3) AS k", "timestamp_seconds(1700000000 + id * 60) AS ts")
    events.repartitionByRange(4, "id").write.parquet(f"{tmp_path}/e")
    out = counts.run_to_end(counts.count_by(counts.stream_of(spark, f"{tmp_path}/e"), "k"), "complete")
    assert {tuple(r) for r in out.collect()} == {("k0", 134), ("k1", 133), ("k2", 133)}
    updates = counts.run_to_end(counts.count_by(counts.stream_of(spark, f"{tmp_path}/e"), "k"), "update")
    assert updates.count() > 3 and updates.agg(F.max("n")).first()[0] == 134
    w = counts.run_to_end(counts.windowed(counts.stream_of(spark, f"{tmp_path}/e"), "ts", "10 minutes", "1 hour"), "append")
    assert 0 < w.agg(F.sum("n")).first()[0] < 400  # windows behind the watermark only
    s = counts.run_to_end(counts.sessions(counts.stream_of(spark, f"{tmp_path}/e"), "ts", "1 minute", "5 minutes", "k"), "append")
    assert s.columns == ["session_window", "k", "n"]


def test_conf(spark):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    EngineConf.from_options({"amplify": "true", "target-batch-size-mb": "32"}).apply(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "32m"
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    with pytest.raises(ValueError):
        EngineConf.from_options({"nonsense": "1"})
    df = spark.range(10)
    for h in HINTS:
        df = df.hint(h, True)
    assert df.count() == 10
    x = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    x.collect()
    assert any("numOutputRows" in m for m in metrics(x).values())


def test_storage(spark):
    assert free_name("a", ["A", "a_"]) == "a__"
    df = spark.createDataFrame([(1, None)], "a int, b string")
    kept = materialize(df, "x")
    assert kept.collect() == df.collect()
    release(spark)
    assert materialize(df, "y").collect() == df.collect()


def test_without_the_subpackage(monkeypatch):
    """The queries of the library are there when a module that only the subpackage needs is not."""
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(k.startswith(('p3_', 'p5_', 'p6_', 'p7_')) for k in q), sorted(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_more_text(spark):
    t = "Aé漢😀\n"
    assert one(spark, text.code_points(F.lit(t))) == [ord(c) for c in t] and one(spark, text.code_points(F.lit(""))) == [] and one(spark, text.code_points(F.lit(None).cast("string"))) is None
    assert one(spark, text.from_code_points(F.lit([ord(c) for c in t]))) == t and one(spark, text.from_code_points(F.array().cast("array<int>"))) == ""
    assert one(spark, text.like(F.lit("a%b\n"), "a\\%b_")) and not one(spark, text.like(F.lit("axb\n"), "a\\%b_")) and one(spark, text.like(F.lit("a.c"), "a.%")) and not one(spark, text.like(F.lit("abc"), "a.%"))
    assert one(spark, text.like(F.lit(None).cast("string"), "%")) is None


def test_more_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(1.0), F.lit(3.0), F.lit(2.0))
    none = F.array().cast("array<double>")
    assert one(spark, vectors.order(v)) == [1, 3, 0, 2] and one(spark, vectors.encode_unique(v)) == [2, 0, 2, 1]
    assert one(spark, vectors.order(none)) == [] and one(spark, vectors.is_uniform(none)) and one(spark, vectors.scaled_sum(none, 2.0)) == 0
    assert one(spark, vectors.arrange(0, 5, 2)) == [0, 2, 4] and one(spark, vectors.arrange(5, 0, -2)) == [5, 3, 1] and one(spark, vectors.arrange(3, 3)) == [] and one(spark, vectors.arrange(3, 9, -1)) == []
    assert one(spark, vectors.full(3, 1.5)) == [1.5] * 3 and one(spark, vectors.places(v, lambda x: x > 2)) == [0, 2] and one(spark, vectors.places(none, lambda x: x > 2)) == []
    assert one(spark, vectors.smaller(v, F.reverse(v))) == [2.0, 1.0, 1.0, 2.0] and one(spark, vectors.larger(v, F.reverse(v))) == [3.0, 3.0, 3.0, 3.0]


def test_nanoseconds(spark):
    a, b = F.lit(-1_500_000_001), F.lit(2_000_000_000)
    assert one(spark, dates.nanosecond(a)) == 499_999_999 and one(spark, dates.nanos_apart("second", a, b)) == -3 and one(spark, dates.nanos_apart("nanosecond", b, a)) == 3_500_000_001
    assert one(spark, dates.add_nanos(a, "second", 2)) == 499_999_999


def test_batches(spark):
    df = spark.createDataFrame([(k, v) for k in (1.0, 2.0, None) for v in range(5)], "k double, v long").repartition(2)
    out = batches.execute_multi(df, lambda b: [(0, b[b.v % 2 == 0]), (5, b[b.v % 2 == 1])], "k double, v long")
    assert out.columns == ["bucket", "k", "v"] and {(r["bucket"], r["v"] % 2) for r in out.collect()} == {(0, 0), (5, 1)} and out.count() == 15
    with pytest.raises(Exception, match="0 to 63"):
        batches.execute_multi(df, lambda b: [(64, b)], "k double, v long").collect()
    other = spark.createDataFrame([(1.0, "x"), (None, "y"), (7.0, "z")], "k double, w string")
    for split in (1, 3):
        met = batches.execute_join(df, other, ["k"], lambda a, b: a.merge(b[["w"]], how="cross")[["v", "w"]], "v long, w string", split)
        assert sorted(map(tuple, met.collect())) == sorted((v, w) for w in "xy" for v in range(5))
    assert batches.execute_join(df.where("false"), other, ["k"], lambda a, b: b[["w"]], "w string").count() == 3
    grouped = batches.execute_grouping(df, lambda b: b.groupby("k", dropna=False, as_index=False).v.sum(), "k double, v long", "k", lambda x: x.groupBy("k").agg(F.sum("v").alias("v")))
    assert {r["v"] for r in grouped.collect()} == {10} and grouped.count() == 3
    assert batches.execute(df.where("false"), lambda b: b, "k double, v long").collect() == []


def test_spans(spark):
    rows = [("c", "S:a", 0), ("c", "S:b", 1), ("c", "S:a", 2), ("c", "E:a", 5), ("d", "S:a", 5), ("c", "E:b", 6), ("c", "E:a", 9), ("d", "E:a", 9), ("c", "note", 3), ("c", "S:open", 4)]
    df = spark.createDataFrame([(c, p, datetime(2024, 1, 1, 0, 0, t), i) for i, (c, p, t) in enumerate(rows)], "c string, p string, t timestamp, i int")
    found = trace.spans(df, "c", "p", "t", "i")
    assert sorted((r["context"], r["name"], r["micros"] // 10**6) for r in found.collect()) == [("c", "a", 3), ("c", "a", 9), ("c", "b", 5), ("d", "a", 4)]
    assert [tuple(r) for r in trace.summary(found).where("name = 'a'").collect()] == [("a", 3, 4e6, 9 * 10**6, 16 * 10**6)]
    with pytest.raises(Exception, match="no start for the end of a"):
        trace.spans(df.where("i > 2"), "c", "p", "t", "i").collect()


def test_event_log(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(json.dumps(x) for x in [{"Event": "SparkListenerTaskEnd", "Stage ID": 3, "Task Info": {"Task ID": k, "Launch Time": 1000, "Finish Time": 1000 + k, "Executor ID": "1"}} for k in (5, 7)] + [{"Event": "Other"}]))
    found = trace.spans(trace.task_records(spark, str(tmp_path / "log")), "context", "position", "instant", "tie")
    assert sorted((r["name"], r["micros"]) for r in found.collect()) == [("stage 3", 5000), ("stage 3", 7000)]


def test_values_of_a_hot_key(spark):
    t = Typed.from_range(spark, 1, 1000).group_values(lambda x: F.when(x > 900, x % 3).otherwise(None), 250)
    got = {(r["key"], r["part"]): r["values"] for r in t.collect()}
    assert [len(got[None, i]) for i in range(4)] == [250, 250, 250, 150] and sum(map(len, got.values())) == 1000 and max(map(len, got.values())) == 250
    assert got[0, 0] == list(range(903, 1001, 3))
    pairs = Typed.from_range(spark, 1, 4).map(lambda x: (x % 2, x)).group_values(lambda k, x: k)
    assert {r["key"]: [v["_2"] for v in r["values"]] for r in pairs.collect()} == {0: [2, 4], 1: [1, 3]}
    r = Typed.from_range(spark, 1, 10)
    assert r.reduce(operator.xor) == 11 and r.reduce("or") == 15 and r.reduce(operator.and_) == 0 and r.map(lambda x: x > 0).reduce(all) and r.map(lambda x: x > 9).reduce("any")
    assert sorted(r.to_rdd().collect()) == list(range(1, 11)) and r.map(lambda x: (x, x)).to_rdd().first() == (1, 1)


def test_tables_are_compared(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert sets.same_rows(a, a.repartition(3)) and not sets.same_rows(a, a.distinct()) and not sets.same_rows(a, a.withColumnRenamed("v", "w")) and sets.same_rows(a.where("false"), a.where("false"))
    assert sets.same_order(a, ["k"], a.orderBy("v"), ["k"]) and not sets.same_order(a, ["k"], a, [F.desc("k")])


def test_join_calls_for_parts_with_rows_only(spark):
    """Split by 50, a key of one row is one call, not 50; and integers beyond 2**53 beside nulls stay exact."""
    big = 2**53 + 1
    left = spark.createDataFrame([(k, big + k) for k in range(40)] + [(None, 1), (50, None), (0, 7)], "k long, i long").repartition(3)
    right = spark.createDataFrame([(k % 40, "ab"[k % 2]) for k in range(200)] + [(None, "z"), (77, "q")], "k long, w string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def f(a, b):
        calls.add(1)
        return pd.DataFrame({"k": a["k"], "i": a["i"], "n": np.int64(len(b)), "w": "".join(sorted(b["w"])), "kinds": f"{a['i'].dtype} {a.index.tolist() == [*range(len(a))]} {a.columns.tolist()}"})

    for split in (1, 50):
        before = calls.value
        got = batches.execute_join(left, right, ["k"], f, "k long, i long, n long, w string, kinds string", split).collect()
        assert calls.value - before <= 43
        want = {(k, big + k): "ab"[k % 2] * 5 for k in range(40)} | {(None, 1): "z", (50, None): "", (0, 7): "aaaaa"}
        assert {(r["k"], r["i"]): r["w"] for r in got} == want and all(r["n"] == len(r["w"]) for r in got)
        assert all(r["kinds"] == f"{'float64' if r['i'] is None else 'int64'} True ['k', 'i']" for r in got)


def test_groups_over_batches(spark):
    """A group goes over as many batches as it has; null, NaN and zeros of either sign are keys; other types go by cogroup."""
    nan = float("nan")
    left = spark.createDataFrame([(k, i) for k in (None, nan, -1.5) for i in range(25)] + [(0.0, 1), (-0.0, 2)], "k double, i long").repartition(4)
    right = spark.createDataFrame([(None, "x"), (nan, "y"), (0.0, "z"), (3.0, "u")], "k double, w string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for split in (1, 2):
            for r in (right, right.withColumn("a", F.array("w"))):
                got = batches.execute_join(left, r, ["k"], lambda a, b: pd.DataFrame({"i": a["i"], "m": np.int64(len(a)), "w": b["w"].sum() if len(b) else ""}), "i long, m long, w string", split).collect()
                assert sorted((x["w"], x["i"]) for x in got) == sorted([(w, i) for w in ("", "x", "y") for i in range(25)] + [("z", 1), ("z", 2)])
                assert split > 1 or {(x["w"], x["m"]) for x in got} == {("", 25), ("x", 25), ("y", 25), ("z", 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="should be"):
        batches.execute_join(left, right, ["k"], lambda a, b: a, "i long").collect()


def test_embedded_database(spark, tmp_path):
    """Odd texts, nulls and no rows at all come back from the packed database as they went in."""
    texts = ["  a ", " ", "", None, "a\nb", "a\r\nb", 'q"x', '"', "\\", "é,\\,", "NULL", "'", ",", "x" * 40_000]
    rows = [(i, t, None if i % 5 == 0 else i / 7, datetime(2024, 1, 1 + i, 1, 2, 3, 456789) if i % 3 else None, i % 2 == 0, bytes([i, 0, 255])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, s string, d double, t timestamp, b boolean, y binary").repartition(3)
    url = io.derby(df, "odd", f"file://{tmp_path}/odd")
    assert sorted(map(tuple, io.jdbc(spark, url, "odd", "k", 0, 10, 4, driver=io.DERBY).collect())) == rows
    assert io.jdbc(spark, io.derby(df.where("k < 0"), "odd", f"file://{tmp_path}/nothing"), "odd", driver=io.DERBY).count() == 0
    with pytest.raises(ValueError, match="file system"):
        io.derby(df, "odd", "hdfs:///odd")


def test_database_with_executors_of_their_own(data, tmp_path):
    """Executors in other processes than the driver read the database that was written."""
    (tmp_path / "home/work").mkdir(parents=True)  # where executors' logs go
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    code = f"""
import __spark_entry__
from brindle.session import session
s = session("local-cluster[2,1,1024]", "cluster", 2, spark__executor__memory="600m", spark__checkpoint__dir="file://{tmp_path}/shared")
names = ["s_suppkey", "s_name", "s_acctbal"]
got = __spark_entry__.queries()["scan_jdbc_roundtrip"](s, "{data}")
assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(map(tuple, s.read.parquet("{data}/supplier.parquet").select(names).collect()))
"""
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], env=env, timeout=300)
