"""One query per operator and function of the inventory, most with a twin in SQL.

Reals are rounded so that the order of a sum's terms does not show. All queries read whole tables."""

from __future__ import annotations

import operator
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from brindle import batches, trace
from brindle.conf import EngineConf, metrics
from brindle.functions import dates, scalar, text, vectors
from brindle.operators import joins, ordered, sets
from brindle.plans.sql import Book
from brindle.session import table
from brindle.sources import tables as io
from brindle.storage import is_one_process, materialize, shared_dir
from brindle.streaming import counts as streams
from brindle.typed import Typed

_book = Book()
QUERIES, SQL = _book.queries, _book.sql
_q, _add = _book.text, _book.add


def _on(name: str, tbl: str, make, sql: str | None = None) -> None:
    """A query made from one table."""
    _add(name, lambda spark, d: make(table(spark, d, tbl)), sql)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


# ---- scans, sources, sinks -------------------------------------------------------------------------------------------

_on("scan_parquet", "supplier", lambda t: t.withColumnsRenamed({"s_suppkey": "supplier_key", "s_name": "supplier_name"}), "SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_nationkey, s_acctbal FROM supplier")
_on("scan_pruned", "lineitem", lambda t: t.where("l_quantity < 3").select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 3")


def _trip(kind: str, tbl: str, reader):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, df = _folder(spark), table(spark, d, tbl)
        io.write(df, path, kind)
        return reader(spark, path, df.schema)

    return run


_add("scan_csv_roundtrip", _trip("csv", "shop_items", io.csv), "SELECT item_id, item, item_group, unit_price FROM shop_items")
_add("scan_json_roundtrip", _trip("json", "customer", io.json), "SELECT * FROM customer")
_add("scan_orc_roundtrip", _trip("orc", "part", lambda s, p, _: s.read.orc(p)), "SELECT * FROM part")
_add("scan_object_roundtrip", _trip("parquet", "supplier", lambda s, p, _: io.parquet(s, p)), "SELECT * FROM supplier")


def _tbl(spark: SparkSession, d: str) -> DataFrame:
    path, df = _folder(spark), table(spark, d, "nation")
    io.write(df.select(F.concat_ws("|", *df.columns, F.lit("")).alias("value")), path, "text")
    return io.tbl(spark, path, df.schema)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    io.write(table(spark, d, "part").select(F.col("p_name").alias("value")), path, "text")
    words = io.text(spark, path).select(F.explode(F.split("value", " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    io.write(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, by=["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


_clear: dict[str, DataFrame] = {}


def _cached(t: DataFrame) -> DataFrame:
    """The table from Spark's columnar cache. A marking column makes the cached plan one that no other query has, so that
    nothing else is answered from it; the cache of the query before is released."""
    for old in _clear.values():
        old.unpersist()
    _clear["last"] = t.withColumn("_from_cache", F.lit(uuid.uuid4().hex)).cache()
    return _clear["last"].drop("_from_cache")


_add("scan_tbl_roundtrip", _tbl, "SELECT * FROM nation")
_add("scan_text_wordcount", _lines, "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
_add("scan_partitioned_write", _partitioned, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
_q("scan_values", "SELECT * FROM VALUES (CAST(1 AS DOUBLE), CAST(2 AS DOUBLE)), (2, -1), (3, 1), (4, -4), (52, 11) AS v(a, b)", "SELECT * FROM (VALUES (CAST(1 AS DOUBLE), CAST(2 AS DOUBLE)), (2, -1), (3, 1), (4, -4), (52, 11)) AS v(a, b)")
_add("scan_range", lambda spark, d: io.numbers(spark, 1, 1000), "SELECT unnest(range(1, 1001)) AS id")
_add("scan_generator", lambda spark, d: io.points(spark, 1000).repartition(7).agg(F.count(F.lit(1)).alias("n"), F.min((F.col("id") >= 0) & (F.col("id") < 100) & (F.col("id") == F.floor("id"))).alias("ids"), F.min((F.col("double_x") >= 0) & (F.col("double_x") < 1)).alias("x"), (F.abs(F.avg("double_y") - 0.5) < 0.05).alias("mean"), F.count_distinct("double_x").alias("different")), "SELECT CAST(1000 AS BIGINT) AS n, true AS ids, true AS x, true AS mean, CAST(1000 AS BIGINT) AS different")


def _jdbc(spark: SparkSession, d: str) -> DataFrame:
    """A table written to a database and read back in parallel ranges of a key; the database is the one that Spark brings.
    It is embedded, so rows are written by JDBC where all runs in one process; else by `io.derby`."""
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    if is_one_process(spark):
        url = f"jdbc:derby:memory:b{uuid.uuid4().hex};create=true"
        io.write_jdbc(df.coalesce(1), url, "supplier", driver=io.DERBY)
    else:
        url = io.derby(df, "supplier", _folder(spark))
    return io.jdbc(spark, url, "supplier", "s_suppkey", 0, 1000, 4, driver=io.DERBY).select(*(F.col(c).alias(c.lower()) for c in ("S_SUPPKEY", "S_NAME", "S_ACCTBAL")))


def _written(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return io.write_to(done, f"written_{uuid.uuid4().hex}", _folder(spark))


_add("scan_jdbc_roundtrip", _jdbc, "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
_add("sink_write_to", _written, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
_add("scan_rows", lambda spark, d: io.rows(spark, [("a", 1), ("b", 2), (None, 3)], "k string, v int"), "SELECT * FROM (VALUES ('a', 1), ('b', 2), (NULL, 3)) AS v(k, v)")
_add("scan_from_rdd", lambda spark, d: io.from_rdd(spark, table(spark, d, "region").select("r_regionkey", "r_name").rdd, "r_regionkey int, r_name string"), "SELECT r_regionkey, r_name FROM region")
_on("scan_cached", "customer", lambda t: _cached(t).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
_on("scan_cached_filter", "customer", lambda t: _cached(t).where("c_acctbal > 5000").select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
_on("scan_csv_quoted", "shop_items", lambda t: t.select("item_id", text.quote_csv(F.col("item")).alias("quoted")), """SELECT item_id, '"' || replace(item, '"', '""') || '"' AS quoted FROM shop_items""")

# ---- projection and filter -------------------------------------------------------------------------------------------

_q("proj_arith", "SELECT l_orderkey, round(l_quantity * 2 + l_extendedprice - 1, 4) AS x, -l_linenumber AS neg FROM lineitem")
_q("proj_passthrough", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
_q("proj_string_choice", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS kind FROM customer")



def _nan(x: str, name: str, digits: int | None = None) -> str:
    """A real as two columns, as NaN is equal to nothing: the value (null for NaN, no negative zero) and whether it is NaN."""
    value = f"round({x}, {digits})" if digits else x
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {value} + CAST(0 AS DOUBLE) END AS {name}, coalesce(isnan({x}), false) AS {name}_nan"


_q("proj_pairwise_add", f"SELECT id, {_nan('double_x + double_y', 's')} FROM xy_points")
_q("proj_cte", "WITH t(a, n) AS (SELECT p_type, count(*) FROM part GROUP BY p_type) SELECT a, n FROM t WHERE n > 1")


def _view(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2)).toDF("supplier_no", "total").createOrReplaceTempView("revenue_by_supplier")
    return spark.table("revenue_by_supplier")


_add("proj_view_columns", _view, "SELECT l_suppkey AS supplier_no, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_suppkey")


def _sql_view(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("sold")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW revenue (supplier_no, total) AS SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) FROM sold GROUP BY l_suppkey")
    return spark.sql("SELECT supplier_no, total FROM revenue WHERE total > 0")


_add("proj_view_sql", _sql_view, "SELECT * FROM (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey) WHERE total > 0")
_q("proj_derived_aliases", "SELECT k, n FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) AS t(k, n)")
_on("proj_chained_columns", "xy_points", lambda t: _chain(t, 10).select("id", F.round("x", 6).alias("x")), "SELECT id, round(double_x + 10, 6) AS x FROM xy_points")


def _chain(t: DataFrame, n: int) -> DataFrame:
    t = t.withColumn("x", F.col("double_x"))
    for _ in range(n):
        t = t.withColumn("x", F.col("x") + 1)
    return t


_q("filter_basic", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.05")
_q("filter_coalesce", "SELECT ColA, ColB, ColC, ColD FROM nums WHERE coalesce(ColC + ColD, 25) > 24")
_q("filter_and_or_null", "SELECT ColA, ColB FROM nums WHERE (ColA > 2 AND ColB < 5) OR ColA IS NULL")
_q("filter_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_q("filter_scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_q("filter_correlated_subquery", "SELECT p_partkey FROM part p WHERE p_size = (SELECT max(q.p_size) FROM part q WHERE q.p_brand = p.p_brand)")
_q("filter_null_not_equal", "SELECT ColA FROM nums WHERE NOT (ColA = 2)")

# ---- scalar expressions ----------------------------------------------------------------------------------------------

def _expr(name: str, tbl: str, key: list[str], columns, sql: str) -> None:
    cols = lambda: columns(*map(F.col, ["ColA", "ColB", "ColC", "ColD", "p_name"]))
    _on(f"expr_{name}", tbl, lambda t: t.select(*key, *(c.alias(k) for k, c in cols().items())), f"SELECT {', '.join([*key, sql])} FROM {tbl}")


_expr("safe_divide", "nums", ["ColA", "ColB"], lambda a, b, c, e, _s: {"x": scalar.plain_zero(F.round(scalar.safe_divide(a, b - 3), 8))}, "round(ColA / nullif(ColB - 3, 0), 8) + 0.0::DOUBLE AS x")
_expr("modulo", "nums", ["ColD"], lambda a, b, c, e, _s: {"x": scalar.safe_mod(e.cast("int"), F.lit(3)), "even": scalar.is_even(e)}, "CAST(ColD AS INT) % 3 AS x, ColD % 2 = 0 AS even")
_expr("compare", "nums", ["ColA", "ColB"], lambda a, b, c, e, _s: {"eq": a == b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "ne": a != b}, "ColA = ColB AS eq, ColA < ColB AS lt, ColA <= ColB AS le, ColA > ColB AS gt, ColA >= ColB AS ge, ColA <> ColB AS ne")
_expr("kleene", "nums", ["ColA", "ColB"], lambda a, b, c, e, _s: {"x": (a > 2) & (b > 2), "y": (a > 2) | (b > 2)}, "(ColA > 2 AND ColB > 2) AS x, (ColA > 2 OR ColB > 2) AS y")
_expr("bitwise", "customer", ["c_custkey"], lambda a, b, c, e, _s: {"x": F.col("c_custkey").bitwiseAND(12), "y": F.col("c_custkey").bitwiseOR(12), "z": F.col("c_custkey").bitwiseXOR(12), "w": F.bitwise_not("c_custkey")}, "c_custkey & 12 AS x, c_custkey | 12 AS y, xor(c_custkey, 12) AS z, ~c_custkey AS w")
_expr("not", "nums", ["ColA"], lambda a, b, c, e, _s: {"x": ~(a > 3)}, "NOT (ColA > 3) AS x")
_expr("sqrt", "nums", ["ColA"], lambda a, b, c, e, _s: {"x": F.round(F.sqrt(F.abs(a)), 8)}, "round(sqrt(abs(ColA)), 8) AS x")
_expr("coalesce", "nums", ["ColA", "ColB", "ColC"], lambda a, b, c, e, _s: {"x": F.coalesce(a, b, c, F.lit(-1.0))}, "coalesce(ColA, ColB, ColC, -1.0::DOUBLE) AS x")
_expr("is_null", "nums", ["ColA"], lambda a, b, c, e, _s: {"x": a.isNull()}, "ColA IS NULL AS x")
_expr("is_not_null", "documents", ["doc_id"], lambda a, b, c, e, _s: {"x": F.col("text").isNotNull()}, "text IS NOT NULL AS x")
_expr("isnan", "xy_points", ["id"], lambda a, b, c, e, _s: {"x": F.when(F.col("double_x").isNotNull(), F.isnan("double_x"))}, "isnan(double_x) AS x")
_expr("if", "nums", ["ColA", "ColB"], lambda a, b, c, e, _s: {"x": F.when(a > b, a).otherwise(b)}, "CASE WHEN ColA > ColB THEN ColA ELSE ColB END AS x")
_expr("null_literal", "region", ["r_regionkey"], lambda a, b, c, e, _s: {"x": F.lit(None).cast("int")}, "CAST(NULL AS INT) AS x")
_expr("cast_int", "lineitem", ["l_orderkey"], lambda a, b, c, e, _s: {"x": scalar.safe_cast(F.col("l_extendedprice"), "int")}, "CAST(trunc(l_extendedprice) AS INT) AS x")
_expr("cast_bigint", "lineitem", ["l_orderkey"], lambda a, b, c, e, _s: {"x": F.col("l_extendedprice").cast("bigint")}, "CAST(trunc(l_extendedprice) AS BIGINT) AS x")
_expr("cast_double", "nums", ["ColD"], lambda a, b, c, e, _s: {"x": e.cast("double")}, "CAST(ColD AS DOUBLE) AS x")
_expr("greatest", "nums", ["ColA", "ColB", "ColC"], lambda a, b, c, e, _s: {"x": F.greatest(a, b, c)}, "greatest(ColA, ColB, ColC) AS x")
_expr("least", "nums", ["ColA", "ColB", "ColC"], lambda a, b, c, e, _s: {"x": F.least(a, b, c)}, "least(ColA, ColB, ColC) AS x")
_expr("case_no_else", "nums", ["ColA"], lambda a, b, c, e, _s: {"x": F.when(a > 10, 1)}, "CASE WHEN ColA > 10 THEN 1 END AS x")
_expr("case_multi", "nums", ["ColA"], lambda a, b, c, e, _s: {"x": F.when(a > 10, 2).when(a > 2, 1).otherwise(0)}, "CASE WHEN ColA > 10 THEN 2 WHEN ColA > 2 THEN 1 ELSE 0 END AS x")
_expr("year_ts", "orders", ["o_orderkey"], lambda a, b, c, e, _s: {"x": F.year("o_orderdate")}, "CAST(year(o_orderdate) AS INT) AS x")
_expr("year_date", "orders", ["o_orderkey"], lambda a, b, c, e, _s: {"x": F.year(F.col("o_orderdate").cast("date"))}, "CAST(extract(year FROM CAST(o_orderdate AS DATE)) AS INT) AS x")
for _n, _p in {"prefix": "s%", "suffix": "%e", "infix": "%an%", "two_wildcards": "%a%e%", "underscore": "_a%"}.items():
    _on(f"expr_like_{_n}", "part", lambda t, p=_p: t.where(F.col("p_name").like(p)).select("p_partkey", "p_name"), f"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '{_p}'")
_expr("startswith", "part", ["p_partkey"], lambda a, b, c, e, _s: {"x": F.startswith(_s, F.lit("s"))}, "starts_with(p_name, 's') AS x")
_expr("endswith", "part", ["p_partkey"], lambda a, b, c, e, _s: {"x": F.endswith(_s, F.lit("e"))}, "suffix(p_name, 'e') AS x")
_expr("contains", "part", ["p_partkey"], lambda a, b, c, e, _s: {"x": F.contains(_s, F.lit("an"))}, "contains(p_name, 'an') AS x")
_expr("string_equals", "part", ["p_partkey"], lambda a, b, c, e, _s: {"x": F.col("p_type") == "PROMO"}, "p_type = 'PROMO' AS x")
_expr("string_in", "part", ["p_partkey"], lambda a, b, c, e, _s: {"x": F.col("p_type").isin("PROMO", "LARGE")}, "p_type IN ('PROMO', 'LARGE') AS x")
_expr("number_in", "nums", ["ColA"], lambda a, b, c, e, _s: {"x": a.isin(2.0, 4.0, 52.0)}, "ColA IN (2, 4, 52) AS x")
_expr("date_from_text", "events", ["event_id"], lambda a, b, c, e, _s: {"x": F.try_to_date(F.date_format("ts", "yyyy-MM-dd"))}, "CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS x")
_expr("math", "customer", ["c_custkey"], lambda a, b, c, e, _s: {"s": F.round(F.sin("c_acctbal"), 6), "c": F.round(F.cbrt(F.abs("c_acctbal")), 6), "l": F.round(F.log(F.abs("c_acctbal") + 1), 6), "e": F.round(F.exp(F.col("c_acctbal") / 10000), 6), "p": F.round(F.pow(F.col("c_acctbal"), F.lit(2.0)), 2), "a": F.round(F.atan2("c_acctbal", F.lit(2.0)), 6), "d": F.round(F.degrees("c_acctbal"), 4), "g": F.signum("c_acctbal"), "h": F.round(F.hypot("c_acctbal", F.lit(3.0)), 6)},
      "round(sin(c_acctbal), 6) AS s, round(cbrt(abs(c_acctbal)), 6) AS c, round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_acctbal / 10000), 6) AS e, round(pow(c_acctbal, 2), 2) AS p, round(atan2(c_acctbal, 2), 6) AS a, round(degrees(c_acctbal), 4) AS d, CAST(sign(c_acctbal) AS DOUBLE) AS g, round(sqrt(c_acctbal * c_acctbal + 9), 6) AS h")
_expr("math_more", "customer", ["c_custkey"], lambda a, b, c, e, _s: {"t": F.round(F.tanh(F.col("c_acctbal") / 1000), 6), "ac": F.round(F.acos(F.col("c_acctbal") / 20000), 6), "as_": F.round(F.asin(F.col("c_acctbal") / 20000), 6), "at": F.round(F.atan("c_acctbal"), 6), "co": F.round(F.cos("c_acctbal"), 6), "l2": F.round(F.log2(F.abs("c_acctbal") + 1), 6), "l10": F.round(F.log10(F.abs("c_acctbal") + 1), 6), "r": F.round(F.radians("c_acctbal"), 6), "ch": F.round(F.cosh(F.col("c_acctbal") / 10000), 6), "sh": F.round(F.sinh(F.col("c_acctbal") / 10000), 6)},
      "round(tanh(c_acctbal / 1000), 6) AS t, round(acos(c_acctbal / 20000), 6) AS ac, round(asin(c_acctbal / 20000), 6) AS as_, round(atan(c_acctbal), 6) AS at, round(cos(c_acctbal), 6) AS co, round(log2(abs(c_acctbal) + 1), 6) AS l2, round(log10(abs(c_acctbal) + 1), 6) AS l10, round(radians(c_acctbal), 6) AS r, round(cosh(c_acctbal / 10000), 6) AS ch, round(sinh(c_acctbal / 10000), 6) AS sh")
_expr("digest", "part", ["p_partkey"], lambda a, b, c, e, _s: {"m": F.md5(_s), "s": F.sha2(_s, 256), "b": F.base64(F.encode(_s, "UTF-8")), "l": F.levenshtein(_s, F.lit("salmon")), "n": F.length(_s), "x": F.hex("p_partkey"), "z": F.bin("p_partkey")},
      "md5(p_name) AS m, sha256(p_name) AS s, base64(encode(p_name)) AS b, CAST(levenshtein(p_name, 'salmon') AS INT) AS l, CAST(length(p_name) AS INT) AS n, to_hex(p_partkey) AS x, bin(p_partkey) AS z")
_expr("factorial", "region", ["r_regionkey"], lambda a, b, c, e, _s: {"x": F.factorial("r_regionkey")}, "CAST(factorial(r_regionkey) AS BIGINT) AS x")
# The values of hashes are Spark's own; equal names have equal hashes, and here different ones have different 64-bit hashes.
_on("expr_hashes", "part", lambda t: t.groupBy("p_name").agg(F.count_distinct(F.xxhash64("p_name")).alias("x"), F.count_distinct(F.hash("p_name")).alias("h"), F.count_distinct(F.crc32(F.encode("p_name", "UTF-8"))).alias("c")), "SELECT DISTINCT p_name, CAST(1 AS BIGINT) AS x, CAST(1 AS BIGINT) AS h, CAST(1 AS BIGINT) AS c FROM part")
_on("expr_hash_distinct", "orders", lambda t: t.agg(F.count_distinct(F.xxhash64("o_orderkey")).alias("n")), "SELECT count(DISTINCT o_orderkey) AS n FROM orders")
_expr("math_wish", "customer", ["c_custkey"], lambda a, b, c, e, _s: {"ah": F.round(F.acosh(F.abs("c_acctbal") + 1), 6), "sh": F.round(F.asinh(F.col("c_acctbal") / 100), 6), "th": F.round(F.atanh(F.col("c_acctbal") / 20000), 6), "l1": F.round(F.log1p(F.abs("c_acctbal")), 6), "e1": F.round(F.expm1(F.col("c_acctbal") / 10000), 6), "ri": F.rint("c_acctbal"), "ce": F.ceil("c_acctbal"), "fl": F.floor("c_acctbal"), "sl": F.shiftleft("c_custkey", 3), "sr": F.shiftright("c_custkey", 2)},
      "round(acosh(abs(c_acctbal) + 1), 6) AS ah, round(asinh(c_acctbal / 100), 6) AS sh, round(atanh(c_acctbal / 20000), 6) AS th, round(ln(1 + abs(c_acctbal)), 6) AS l1, round(exp(c_acctbal / 10000) - 1, 6) AS e1, round_even(c_acctbal, 0) AS ri, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, c_custkey << 3 AS sl, c_custkey >> 2 AS sr")
_expr("conv", "part", ["p_partkey"], lambda a, b, c, e, _s: {"x": F.conv(F.col("p_partkey").cast("string"), 10, 16), "b": F.conv(F.col("p_partkey").cast("string"), 10, 2), "s": F.sha1("p_name"), "u": F.unhex(F.hex("p_partkey")).isNotNull(), "ub": F.decode(F.unbase64(F.base64(F.encode(_s, "UTF-8"))), "UTF-8")}, "to_hex(p_partkey) AS x, bin(p_partkey) AS b, sha1(p_name) AS s, true AS u, p_name AS ub")

# ---- joins -----------------------------------------------------------------------------------------------------------


def _two(name: str, left: str, right: str, make, sql: str) -> None:
    _add(f"join_{name}", lambda spark, d: make(table(spark, d, left), table(spark, d, right)), sql)


_two("inner_num", "orders", "customer", lambda o, c: o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_two("inner_string", "trips", "cab_types", lambda t, c: t.join(joins.maybe_broadcast(c.withColumnRenamed("id", "cab")), F.col("cab_type_id") == F.col("cab")).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT type, count(*) AS n FROM trips JOIN cab_types ON cab_type_id = cab_types.id GROUP BY type")
_q("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber")
_q("join_on_expression", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey")
_two("left", "users", "shop_orders", lambda u, o: u.select(F.col("id").alias("user")).join(o.groupBy("userId").agg(F.count(F.lit(1)).alias("n")), F.col("user") == F.col("userId"), "left").select("user", "n"), 'SELECT users.id AS "user", n FROM users LEFT JOIN (SELECT "userId", count(*) AS n FROM shop_orders GROUP BY "userId") o ON users.id = o."userId"')
_two("right", "users", "shop_orders", lambda u, o: u.select(F.col("id").alias("user"), "name").join(o.groupBy("userId").agg(F.count(F.lit(1)).alias("n")), F.col("user") == F.col("userId"), "right").select("user", "userId", "n"), 'SELECT users.id AS "user", o."userId", n FROM users RIGHT JOIN (SELECT "userId", count(*) AS n FROM shop_orders GROUP BY "userId") o ON users.id = o."userId"')
_two("full", "users", "shop_orders", lambda u, o: u.select(F.col("id").alias("user")).join(o.groupBy("userId").agg(F.count(F.lit(1)).alias("n")), F.col("user") == F.col("userId"), "full").select("user", "userId", "n"), 'SELECT users.id AS "user", o."userId", n FROM users FULL JOIN (SELECT "userId", count(*) AS n FROM shop_orders GROUP BY "userId") o ON users.id = o."userId"')
_q("join_full_no_condition", "SELECT x.r_name, y.type FROM region x FULL OUTER JOIN cab_types y ON true")
_q("join_self", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
_q("join_four_way", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_q("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_q("join_semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
_q("join_anti_not_exists", "SELECT id FROM users WHERE NOT EXISTS (SELECT 1 FROM shop_orders WHERE shop_orders.userId = users.id)")
_q("join_anti_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
_q("join_theta_or", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND (l_quantity > 45 OR o_orderpriority = '1-URGENT')")
_two("star_checked", "customer", "nation", lambda c, n: joins.star_join(c.withColumnRenamed("c_nationkey", "n_nationkey"), n, "n_nationkey").select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_two("lookup_misses", "shop_orders", "users", lambda o, u: joins.lookup_misses(o.select("userId").distinct(), u.select(F.col("id").alias("userId")), "userId"), 'SELECT DISTINCT o."userId" FROM shop_orders o WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = o."userId")')
for _n, _o in {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    # Two large sides: the pairs are counted by sorted search. One small side: the pairs
    # themselves. Two sides by ranges: the pairs in packs, of which none is made.
    _two(f"range_{_n}", "orders", "lineitem", lambda o, l, op=_o: joins.inequality_counts(o, l, "o_totalprice", op, "l_extendedprice").groupBy("o_orderpriority").agg(F.sum("n").alias("pairs"), F.max("n").alias("most")),
         f"""WITH c AS (SELECT y, sum(n) AS n FROM (SELECT l_extendedprice AS y, 1 AS n FROM lineitem UNION ALL SELECT DISTINCT o_totalprice, 0 FROM orders) GROUP BY y),
r AS (SELECT y, sum(n) OVER (ORDER BY y {'DESC' if '<' in _o else 'ASC'}) {'' if '=' in _o else '- n'} AS n FROM c)
SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS pairs, CAST(max(n) AS BIGINT) AS most FROM orders JOIN r ON y = o_totalprice GROUP BY o_orderpriority""")
    _two(f"range_pairs_{_n}", "nation", "region", lambda n, r, o=_o: joins.inequality_join(n, r, "n_regionkey", o, "r_regionkey").select("n_name", "r_name"), f"SELECT n_name, r_name FROM nation JOIN region ON n_regionkey {_o} r_regionkey")
    _two(f"range_parts_{_n}", "supplier", "customer", lambda l, r, o=_o: joins.inequality_packs(l, r, "s_acctbal", o, "c_acctbal", {"n": (F.count(F.lit(1)), F.sum), "first": (F.min("c_custkey"), F.min)}, range_rows=500).groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.min("first").alias("first")), f"SELECT s_suppkey, count(*) AS n, min(c_custkey) AS first FROM supplier JOIN customer ON s_acctbal {_o} c_acctbal GROUP BY s_suppkey")


def _band(e: DataFrame) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), (at - 600).alias("low"), at.alias("high"))
    seen = e.where("event_type = 'view'").select("user_id", "event_id", at.alias("x"))
    return joins.band_join(seen, buys, "x", "low", "high", 600.0, ["user_id"]).select("user_id", "event_id", "buy")


_on("join_band", "events", _band, "SELECT v.user_id, v.event_id, p.event_id AS buy FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND date_trunc('second', v.ts) BETWEEN date_trunc('second', p.ts) - INTERVAL 600 SECOND AND date_trunc('second', p.ts)")

# ---- aggregates ------------------------------------------------------------------------------------------------------

_agg = lambda name, columns, tbl="nums", rest="": _q(f"agg_{name}", f"SELECT {columns} FROM {tbl} {rest}")
_agg("sum", "round(sum(ColA), 4) AS a, CAST(sum(ColD) AS BIGINT) AS d, round(sum(ColA - 1), 4) AS s, round(sum(ColB - ColA), 4) AS t")
_agg("avg", "round(avg(ColA), 6) AS a, round(avg(2 * ColB), 6) AS b")
_agg("count_star", "count(*) AS n")
_agg("count_expr", "count(ColA) AS a, count(ColA + ColB) AS b")
_agg("min_max", "min(ColA) AS lo, max(ColB) AS hi, min(ColD) AS d")
_agg("min_max_time", "min(o_orderdate) AS lo, max(o_orderdate) AS hi", "orders")
_agg("corr", "round(corr(ColA, ColB), 8) AS c")
_agg("count_distinct", "count(DISTINCT ColA) AS a, count(DISTINCT ColD) AS d")
_agg("conditional", "CAST(sum(CASE WHEN ColA > 2 THEN 1 ELSE 0 END) AS BIGINT) AS a, count(CASE WHEN ColB > 2 THEN 1 END) AS b")
_agg("expr_over_aggs", "round(sum(ColA + ColB) * 2 - count(*), 4) AS x")
_agg("sum_times_avg", "round(sum(ColA) * avg(ColB), 2) AS x")
_agg("group_1key", "o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s", "orders", "GROUP BY o_orderpriority")
_agg("group_2key", "l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS q", "lineitem", "GROUP BY l_returnflag, l_linestatus")
_agg("group_5key", "p_brand, p_type, p_size, substring(p_name, 1, 1) AS i, p_retailprice > 1500 AS dear, count(*) AS n", "part", "GROUP BY p_brand, p_type, p_size, substring(p_name, 1, 1), p_retailprice > 1500")
_agg("group_null_key", "ColA, count(*) AS n, round(sum(ColB), 4) AS s", "nums", "GROUP BY ColA")
_agg("global", "count(*) AS n, round(sum(l_quantity), 2) AS q, max(l_extendedprice) AS m", "lineitem")
_agg("global_empty", "count(*) AS n, sum(l_quantity) AS q", "lineitem", "WHERE l_quantity < 0")
_agg("key_expression", "CAST(year(o_orderdate) AS INT) AS y, count(*) AS n", "orders", "GROUP BY CAST(year(o_orderdate) AS INT)")
_q("agg_nested_cte", "WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers, round(sum(abs(n - 10)), 2) AS off FROM g GROUP BY n", "WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers, CAST(sum(abs(n - 10)) AS BIGINT) AS off FROM g GROUP BY n")
_agg("stddev_variance", "round(stddev_samp(ColA), 6) AS s, round(stddev_pop(ColA), 6) AS sp, round(var_samp(ColB), 6) AS v, round(var_pop(ColB), 6) AS vp")
_agg("covar", "round(covar_pop(ColA, ColB), 6) AS p, round(covar_samp(ColA, ColB), 6) AS s")
_q("agg_shape", "SELECT round(skewness(ColA), 6) AS s, round(kurtosis(ColA), 6) AS k FROM nums", "SELECT round(skewness(ColA) * (count(ColA) - 2) / sqrt(count(ColA)::DOUBLE * (count(ColA) - 1)), 6) AS s, round(kurtosis_pop(ColA), 6) AS k FROM nums")
_agg("percentile", "round(percentile_cont(0.5) WITHIN GROUP (ORDER BY ColA), 6) AS m")
_agg("filter_clause", "count(*) FILTER (WHERE ColA > 2) AS n")
_agg("string_lengths", "CAST(max(length(p_name)) AS INT) AS hi, CAST(min(length(p_name)) AS INT) AS lo, round(avg(length(p_name)), 6) AS mean", "part")
# An estimate is right if it is within three standard errors of the truth.
_on("agg_approx_distinct", "lineitem", lambda t: t.groupBy("l_returnflag").agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) - F.count_distinct("l_partkey")) <= 0.06 * F.count_distinct("l_partkey")).alias("near")), "SELECT DISTINCT l_returnflag, true AS near FROM lineitem")
_on("agg_percentile_approx", "lineitem", lambda t: t.groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", 0.5, 100_000).alias("m")), "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_returnflag")
_on("agg_group_indexes", "nation", lambda t: t.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("ids")), "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS ids FROM nation GROUP BY n_regionkey")
_q("agg_sum_distinct", "SELECT CAST(sum(DISTINCT ColD) AS BIGINT) AS s FROM nums")

# ---- sort, limit -----------------------------------------------------------------------------------------------------

_q("sort_asc_nulls_first", "SELECT ColA, ColB, ColC, ColD FROM nums ORDER BY ColA ASC NULLS FIRST, ColB NULLS FIRST, ColC NULLS FIRST, ColD NULLS FIRST")
_q("sort_desc_nulls_last", "SELECT ColA, ColB, ColC, ColD FROM nums ORDER BY ColA DESC NULLS LAST, ColB NULLS FIRST")
_q("sort_multi_key", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
_q("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_q("sort_topk_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")



def _search(which: str, down: bool, two: bool) -> None:
    on = ["flag", "price"] if two else ["price"]

    def run(spark: SparkSession, d: str) -> DataFrame:
        k, p = table(spark, d, "lineitem"), table(spark, d, "orders")
        k = k.select(F.ascii("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
        p = p.select("o_orderkey", F.ascii("o_orderstatus").alias("flag"), F.col("o_totalprice").alias("price"))
        return ordered.bounds(k, p, on, [down, not down][: len(on)]).select("o_orderkey", F.col(which).alias("place"))

    a, b = ("ascii(l_returnflag) AS x", "ascii(o_orderstatus) AS x") if two else ("0 AS x", "0 AS x")
    order = f"x {'DESC' if down else 'ASC'}, y {'ASC' if down else 'DESC'}" if two else f"y {'DESC' if down else 'ASC'}"
    place = "s - n" if which == "lower" else "s"
    _add(f"sort_{which}_bound{'_multi' if two else ''}{'_desc' if down else ''}", run, f"""WITH k AS (SELECT {a}, l_extendedprice AS y FROM lineitem), p AS (SELECT o_orderkey, {b}, o_totalprice AS y FROM orders),
c AS (SELECT x, y, sum(n) AS n FROM (SELECT x, y, 1 AS n FROM k UNION ALL SELECT DISTINCT x, y, 0 FROM p) GROUP BY x, y), r AS (SELECT x, y, n, sum(n) OVER (ORDER BY {order}) AS s FROM c)
SELECT o_orderkey, CAST({place} AS BIGINT) AS place FROM p JOIN r USING (x, y)""")


for _w in ("lower", "upper"):
    for _down in (False, True):
        _search(_w, _down, False)
        _search(_w, _down, True)

# ---- sets ------------------------------------------------------------------------------------------------------------

_q("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_q("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT n_regionkey FROM nation")
_q("set_difference", "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation")
_add("set_merge_all", lambda spark, d: sets.merge_all(table(spark, d, "nation").select(F.col("n_name").alias("x")), table(spark, d, "region").select(F.col("r_name").alias("x"))), "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region")


def _merged(name: str, keys: list[str], down: bool, payload: bool) -> None:
    """Merges of two or of many sorted tables, with or without what goes along with the key."""
    parts = {"nation": "n_nationkey, n_name", "region": "r_regionkey, r_name", "supplier": "s_suppkey, s_name", "customer": "c_custkey, c_name"}
    use = {k: parts[k] for k in keys}
    names = ["x", "what"] if payload else ["x"]

    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = [table(spark, d, t).select(*c.split(", ")[: len(names)]).toDF(*names) for t, c in use.items()]
        out = sets.merge_sorted(tables, ["x"], down, "source")
        # The order itself is part of the answer: the place of every row.
        return ordered.numbered(out, [], [F.desc("x") if down else F.asc("x"), "source"], "place") if not payload else out

    sql = " UNION ALL ".join(f"SELECT {c.split(', ')[0]} AS x{', ' + c.split(', ')[1] + ' AS what' if payload else ''}, {i} AS source FROM {t}" for i, (t, c) in enumerate(use.items()))
    place = "" if payload else f", row_number() OVER (ORDER BY x {'DESC' if down else 'ASC'}, source) AS place"
    _add(f"set_{name}", run, f"SELECT *{place} FROM ({sql})")


_two_of, _four_of = ["nation", "region"], ["nation", "region", "supplier", "customer"]
for _n, _args in {"merge_sorted": (_two_of, False, False), "merge_desc": (_two_of, True, False), "merge_pair": (_two_of, False, True), "merge_pair_desc": (_two_of, True, True), "multimerge": (_four_of, False, False), "multimerge_desc": (_four_of, True, False), "multimerge_pair": (_four_of, False, True), "multimerge_pair_desc": (_four_of, True, True)}.items():
    _merged(_n, *_args)
_on("set_unique", "part", lambda t: sets.unique(t, "p_brand", "p_type"), "SELECT DISTINCT p_brand, p_type FROM part")
_on("set_is_unique", "orders", lambda t: sets.is_unique(t, "o_orderkey"), "SELECT count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders")
_on("set_is_not_unique", "orders", lambda t: sets.is_unique(t, "o_custkey"), "SELECT count(*) = count(DISTINCT o_custkey) AS is_unique FROM orders")
_on("set_unique_index", "part", lambda t: sets.unique_index(t, "p_name", "p_partkey"), "SELECT p_name, min(p_partkey) AS first_index, count(*) AS n FROM part GROUP BY p_name")
_on("set_run_starts", "events", lambda t: ordered.run_starts(t, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR p IS DISTINCT FROM event_type")
_on("set_dictionary", "part", lambda t: ordered.dictionary(t, "p_name"), "SELECT p_name AS value, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)")

_on("set_unique_inverse", "part", lambda t: ordered.unique_inverse(t, "p_name", "p_partkey"), "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part")
_two_names = lambda spark, d: (ordered.dictionary(table(spark, d, "nation"), "n_name"), ordered.dictionary(table(spark, d, "customer").select(F.col("c_mktsegment").alias("n_name")), "n_name"))
_add("set_dictionary_lookup", lambda spark, d: ordered.dictionary_lookup(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ordered.dictionary(table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), "c_mktsegment")), "SELECT c_custkey, c_mktsegment, code FROM customer LEFT JOIN (SELECT m, row_number() OVER (ORDER BY m) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS m FROM customer WHERE c_mktsegment <> 'BUILDING')) ON m = c_mktsegment")
_add("set_dictionary_merge", lambda spark, d: ordered.dictionary_merge(*_two_names(spark, d)), "WITH a AS (SELECT n_name AS value, row_number() OVER (ORDER BY n_name) - 1 AS code_a FROM nation), b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code_b FROM (SELECT DISTINCT c_mktsegment AS value FROM customer)) SELECT value, row_number() OVER (ORDER BY value) - 1 AS code, code_a, code_b FROM a FULL JOIN b USING (value)")

_on("col_validity", "nums", lambda t: t.select("ColA", *(F.col(c).isNotNull().cast("int").alias(f"v{c[-1]}") for c in ("ColA", "ColB", "ColD")), *(F.coalesce(c, F.lit(0)).alias(f"d{c[-1]}") for c in ("ColB", "ColD"))), "SELECT ColA, CAST(ColA IS NOT NULL AS INT) AS vA, CAST(ColB IS NOT NULL AS INT) AS vB, CAST(ColD IS NOT NULL AS INT) AS vD, coalesce(ColB, 0) AS dB, CAST(coalesce(ColD, 0) AS INT) AS dD FROM nums")
_same = lambda spark, d: (table(spark, d, "nation"), table(spark, d, "nation").repartition(3), table(spark, d, "nation").where("n_nationkey <> 7"))
_add("col_equals", lambda spark, d: _equal(*_same(spark, d)), "SELECT true AS same, false AS less, true AS ordered, false AS moved")


def _equal(a: DataFrame, b: DataFrame, less: DataFrame) -> DataFrame:
    """Equality of tables as bags of rows, and as rows in an order."""
    spark, k = a.sparkSession, ["n_nationkey"]
    moved = a.withColumn("n_nationkey", (24 - F.col("n_nationkey")).cast(a.schema["n_nationkey"].dataType))
    return io.rows(spark, [(sets.same_rows(a, b), sets.same_rows(a, less), sets.same_order(a, k, b, k), sets.same_order(a, k, moved, k))], "same boolean, less boolean, ordered boolean, moved boolean")


# ---- exchange --------------------------------------------------------------------------------------------------------

_on("xchg_hash_repartition", "orders", lambda t: t.repartition("o_custkey").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders")
_on("xchg_range_repartition", "orders", lambda t: t.repartitionByRange("o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders")
_on("xchg_coalesce", "nation", lambda t: t.coalesce(1), "SELECT * FROM nation")
_on("xchg_union_merge", "lineitem", lambda t: t.select("l_orderkey").union(t.select("l_partkey")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), "SELECT k AS l_orderkey, count(*) AS n FROM (SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY k")
_on("xchg_hints", "nation", lambda t: t.hint("SORT_ON_VE", True).hint("SKIP_VE", False).select("n_name"), "SELECT n_name FROM nation")

_on("xchg_rebalance", "lineitem", lambda t: t.where("l_quantity < 3").hint("rebalance", "l_suppkey").select("l_orderkey", "l_suppkey"), "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity < 3")


def _switched(spark: SparkSession, d: str) -> DataFrame:
    """A grouping under other batch sizes, and with amplified batches; the settings are put back."""
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.inMemoryColumnarStorage.batchSize")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        EngineConf.from_options({"amplify": "true", "column-batch-size": "500", "target-batch-size-mb": "1", "sort": "true", "project": "true", "filter": "true", "exchange": "true", "pass-through": "true", "join": "true"}).apply(spark)
        return materialize(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "switched")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _metered(spark: SparkSession, d: str) -> DataFrame:
    """What the operators of an executed plan report: rows of the scan and of the groups."""
    done = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    done.collect()  # five rows
    found = metrics(done)
    scan = next(v for k, v in found.items() if k.startswith("Scan"))
    return io.rows(spark, [(scan["numOutputRows"], min(v["numOutputRows"] for k, v in found.items() if k == "HashAggregate") > 0, scan["operators"])], "scanned bigint, grouped boolean, scans bigint")


_add("conf_switches", _switched, "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
_add("conf_metrics", _metered, "SELECT count(*) AS scanned, true AS grouped, CAST(1 AS BIGINT) AS scans FROM orders")


def _traced(t: DataFrame) -> DataFrame:
    """Records of a start at an event and of an end as many seconds later as its value says, by user and kind."""
    both = F.explode(F.array(F.struct(F.lit("S:").alias("k"), F.col("ts").alias("t"), (F.col("event_id") * 2).alias("i")), F.struct(F.lit("E:").alias("k"), (F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))).alias("t"), (F.col("event_id") * 2 + 1).alias("i"))))
    records = t.where("value >= 0").select("user_id", "event_type", both.alias("r")).select("user_id", F.concat("r.k", "event_type").alias("position"), F.col("r.t").alias("t"), F.col("r.i").alias("i"))
    return trace.summary(trace.spans(records, "user_id", "position", "t", "i"))


_on("trace_spans", "events", _traced, """WITH r AS (SELECT user_id, event_type AS name, 1 AS step, ts AS t, event_id * 2 AS i FROM events WHERE value >= 0
UNION ALL SELECT user_id, event_type, -1, ts + INTERVAL (CAST(floor(value) AS BIGINT)) SECOND, event_id * 2 + 1 FROM events WHERE value >= 0),
d AS (SELECT *, sum(step) OVER (PARTITION BY user_id, name ORDER BY t, i) + CASE WHEN step = -1 THEN 1 ELSE 0 END AS depth FROM r),
p AS (SELECT *, lag(t) OVER (PARTITION BY user_id, name, depth ORDER BY t, i) AS start FROM d)
SELECT name, count(*) AS count, median(epoch_us(t) - epoch_us(start)) AS median, max(epoch_us(t) - epoch_us(start)) AS longest, CAST(sum(epoch_us(t) - epoch_us(start)) AS BIGINT) AS total FROM p WHERE step = -1 GROUP BY name""")

# ---- typed collections -----------------------------------------------------------------------------------------------


def _one(spark: SparkSession, x, kind: str) -> DataFrame:
    return spark.createDataFrame([(x,)], f"x {kind}")


def _of(name: str, tbl: str, columns: list[str], make, sql: str) -> None:
    """A typed collection of some columns of a table."""
    _add(f"typed_{name}", lambda spark, d: make(spark, Typed(table(spark, d, tbl).select(*columns))), sql)


_ids = ["o_custkey"]
_of("map", "orders", _ids, lambda s, t: t.map(lambda x: x * 2 + 1).df, "SELECT o_custkey * 2 + 1 AS _1 FROM orders")
_of("map_choice", "nums", ["ColA", "ColD"], lambda s, t: t.map(lambda a, d: F.when(a > 3, d.cast("double")).when(a.isNull(), -1.0).otherwise(a.cast("int").cast("double"))).df, "SELECT CASE WHEN ColA > 3 THEN CAST(ColD AS DOUBLE) WHEN ColA IS NULL THEN -1.0 ELSE CAST(CAST(trunc(ColA) AS INT) AS DOUBLE) END AS _1 FROM nums")
_of("filter", "orders", _ids, lambda s, t: t.filter(lambda x: x % 3 == 0).df, "SELECT o_custkey AS _1 FROM orders WHERE o_custkey % 3 = 0")
_of("reduce_sum", "orders", _ids, lambda s, t: _one(s, t.reduce("sum"), "bigint"), "SELECT CAST(sum(o_custkey) AS BIGINT) AS x FROM orders")
_of("reduce_product", "region", ["r_regionkey"], lambda s, t: _one(s, t.map(lambda x: x + 1).reduce("product"), "double"), "SELECT product(r_regionkey + 1) AS x FROM region")
_of("reduce_bits", "orders", ["o_orderkey"], lambda s, t: _one(s, t.reduce(operator.xor), "bigint"), "SELECT bit_xor(o_orderkey) AS x FROM orders")
_of("reduce_any", "orders", ["o_orderkey"], lambda s, t: _one(s, t.reduce(lambda x, y: x ^ y), "bigint"), "SELECT bit_xor(o_orderkey) AS x FROM orders")
_of("group_by", "lineitem", ["l_partkey"], lambda s, t: t.group_by(lambda x: x % 7).agg(F.count(F.lit(1)).alias("n"), F.sum("_1").alias("s")), "SELECT l_partkey % 7 AS key, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY l_partkey % 7")
_of("group_values", "orders", ["o_orderkey"], lambda s, t: t.group_values(lambda x: x % 5, 100), "SELECT key, CAST((n - 1) // 100 AS INT) AS part, list(x ORDER BY x) AS values FROM (SELECT o_orderkey % 5 AS key, o_orderkey AS x, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) AS n FROM orders) GROUP BY key, (n - 1) // 100")
_of("sort_by", "customer", ["c_acctbal", "c_custkey"], lambda s, t: t.sort_by(lambda a, k: -a).df, "SELECT c_acctbal AS _1, c_custkey AS _2 FROM customer ORDER BY c_acctbal DESC")
_of("flat_map", "part", ["p_name"], lambda s, t: t.flat_map(lambda x: F.split(x, " ")).df, "SELECT unnest(string_split(p_name, ' ')) AS _1 FROM part")
_of("tuple_map", "nums", ["ColA", "ColB"], lambda s, t: t.map(lambda a, b: (a, a * b)).df, "SELECT ColA AS _1, ColA * ColB AS _2 FROM nums")
_of("loop", "part", ["p_size"], lambda s, t: t.map_batches(_collatz, "steps bigint").df, "WITH RECURSIVE c AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS x, 0 AS n FROM part UNION ALL SELECT k, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, n + 1 FROM c WHERE x > 1) SELECT CAST(max(n) AS BIGINT) AS _1 FROM c GROUP BY k")
_add("typed_join", lambda s, d: Typed(table(s, d, "customer").select("c_custkey", "c_name")).join(Typed(table(s, d, "orders").select("o_custkey", "o_orderkey"))).df, "SELECT c_custkey AS _1, c_name AS _2, o_orderkey AS _3 FROM customer JOIN orders ON c_custkey = o_custkey")
_add("typed_range", lambda s, d: Typed.from_range(s, 1, 1000).map(lambda x: x * x).filter(lambda x: x % 2 == 1).df, "SELECT i * i AS _1 FROM range(1, 1001) t(i) WHERE i % 2 = 1")
_add("typed_rdd", lambda s, d: Typed.from_rows(s, Typed(table(s, d, "nation").select("n_nationkey", "n_name")).to_rdd().map(lambda r: (r[0] + 1, r[1])).collect(), "k int, n string").df, "SELECT n_nationkey + 1 AS _1, n_name AS _2 FROM nation")  # 25 rows, fixed
_add("typed_collect", lambda s, d: Typed.from_rows(s, [(x,) for x in Typed(table(s, d, "region").select("r_name")).collect()], "n string").df, "SELECT r_name AS _1 FROM region")


def _collatz(batches):
    """A loop in the user's function, over whole columns."""
    for b in batches:
        x, n = b["_1"].to_numpy().astype("int64"), np.zeros(len(b), np.int64)
        while (x > 1).any():
            on = x > 1
            x = np.where(on, np.where(x % 2 == 0, x // 2, 3 * x + 1), x)
            n += on
        yield pd.DataFrame({"steps": n})


_add("typed_instants", lambda s, d: Typed(table(s, d, "events").select("ts", "event_id")).filter(lambda t, i: t > F.lit("2024-01-15").cast("timestamp_ntz")).map(lambda t, i: i).df, "SELECT event_id AS _1 FROM events WHERE ts > TIMESTAMP '2024-01-15'")

# ---- user code over batches ------------------------------------------------------------------------------------------


def _doubled(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"k": b["o_orderkey"], "x": b["o_totalprice"] * 2})


def _by_sign(b: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    low = b["c_acctbal"] < 0
    return [(0, b[low]), (1, b[~low])]


def _told(number: int, b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"name": b["name"].str.lower(), "source": pd.Series(number, index=b.index, dtype="int32")})


def _met(c: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
    """Customers with their orders' number and highest price."""
    return pd.DataFrame({"k": c["k"], "n": np.int64(len(o)), "top": o["price"].max() if len(o) else np.nan})


def _partial(b: pd.DataFrame) -> pd.DataFrame:
    g = b.groupby("l_suppkey")["l_quantity"]
    return pd.DataFrame({"k": g.size().index, "n": g.size().to_numpy(), "q": g.sum().to_numpy()})


_on("batch_execute", "orders", lambda t: batches.execute(t.select("o_orderkey", "o_totalprice"), _doubled, "k bigint, x double").select("k", F.round("x", 2).alias("x")), "SELECT o_orderkey AS k, round(o_totalprice * 2, 2) AS x FROM orders")
_on("batch_execute_multi", "customer", lambda t: batches.execute_multi(t.select("c_custkey", "c_acctbal"), _by_sign, "c_custkey bigint, c_acctbal double"), "SELECT CAST(c_acctbal >= 0 AS INT) AS bucket, c_custkey, c_acctbal FROM customer")
_add("batch_execute_multi_in", lambda spark, d: batches.execute_multi_in([table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name"))], _told, "name string, source int"), "SELECT lower(n_name) AS name, 0 AS source FROM nation UNION ALL SELECT lower(r_name), 1 FROM region")
_two_tables = lambda spark, d: (table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price")))
for _n, _split in {"join": 1, "join_split": 3}.items():
    _add(f"batch_execute_{_n}", lambda spark, d, k=_split: batches.execute_join(*_two_tables(spark, d), ["k"], _met, "k bigint, n bigint, top double", k).where("k IS NOT NULL"), "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_on("batch_execute_grouping", "lineitem", lambda t: batches.execute_grouping(t.select("l_suppkey", "l_quantity"), _partial, "k bigint, n bigint, q double", "k", lambda x: x.groupBy("k").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("q"))), "SELECT l_suppkey AS k, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey")

# ---- text ------------------------------------------------------------------------------------------------------------


def _text(name: str, column, sql: str, tbl: str = "part", key: str = "p_partkey") -> None:
    padded = lambda: F.concat(F.lit("  "), F.col("p_name"), F.lit(" 7 "))
    _on(f"text_{name}", tbl, lambda t: t.select(key, column(F.col("p_name"), F.col("item"), padded()).alias("x")), f"SELECT {key}, {sql} AS x FROM {tbl}")


_text("split", lambda _s, _item, _padded: text.split_words(_item, " ,/"), "list_filter(regexp_split_to_array(item, '[ ,/]'), lambda w: length(w) > 0)", "shop_items", "item_id")
_text("concat", lambda _s, _item, _padded: F.concat_ws("-", "p_name", "p_brand"), "concat_ws('-', p_name, p_brand)")
_text("trim", lambda _s, _item, _padded: F.trim(_padded), "trim('  ' || p_name || ' 7 ')")
_text("trim_chars", lambda _s, _item, _padded: F.btrim(F.col("p_brand"), F.lit("B#1")), "trim(p_brand, 'B#1')")
_text("ltrim", lambda _s, _item, _padded: F.ltrim(_padded), "ltrim('  ' || p_name || ' 7 ')")
_text("rtrim", lambda _s, _item, _padded: F.rtrim(_padded), "rtrim('  ' || p_name || ' 7 ')")
_text("trim_non_letters", lambda _s, _item, _padded: text.trim_non_letters(F.concat(F.lit("12 "), F.col("p_brand"))), "regexp_replace('12 ' || p_brand, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g')")
_text("substr", lambda _s, _item, _padded: F.substring("p_name", 2, 4), "substring(p_name, 2, 4)")
_text("substr_rest", lambda _s, _item, _padded: F.substr(F.col("p_name"), F.lit(3)), "substring(p_name, 3)")
_text("locate", lambda _s, _item, _padded: F.locate("a", "p_name"), "CAST(instr(p_name, 'a') AS INT)")
_text("positions", lambda _s, _item, _padded: text.positions(_s, "a"), "list_filter(CAST(range(1, length(p_name) + 1) AS INT[]), lambda i: substring(p_name, i, 1) = 'a')")
_text("replace", lambda _s, _item, _padded: F.replace(_s, F.lit("a"), F.lit("oo")), "replace(p_name, 'a', 'oo')")
_text("translate", lambda _s, _item, _padded: F.translate(_s, "aeiou", "AEIOU"), "translate(p_name, 'aeiou', 'AEIOU')")
_text("prepend", lambda _s, _item, _padded: F.concat(F.lit("<"), _s), "'<' || p_name")
_text("append", lambda _s, _item, _padded: F.concat(_s, F.lit(">")), "p_name || '>'")
_text("reverse", lambda _s, _item, _padded: F.reverse(_item), "reverse(item)", "shop_items", "item_id")
_text("lower", lambda _s, _item, _padded: F.lower("item"), "lower(item)", "shop_items", "item_id")
_text("upper", lambda _s, _item, _padded: F.upper("item"), "upper(item)", "shop_items", "item_id")
_text("initcap", lambda _s, _item, _padded: F.initcap("p_name"), "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')")
_text("ascii", lambda _s, _item, _padded: F.ascii("p_name"), "CAST(ascii(p_name) AS INT)")
_text("hamming", lambda _s, _item, _padded: text.hamming_distance(_s, F.reverse(_s)), "CAST(hamming(p_name, reverse(p_name)) AS INT)")
_text("parse_int", lambda _s, _item, _padded: text.to_number(F.regexp_extract("p_brand", r"(\d+)", 1), "int"), r"TRY_CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT)")
_text("parse_float", lambda _s, _item, _padded: text.to_number(F.concat(F.col("p_size").cast("string"), F.lit(".5"))), "CAST(p_size || '.5' AS DOUBLE)")
_text("parse_bad", lambda _s, _item, _padded: text.to_number(_s), "TRY_CAST(p_name AS DOUBLE)")
_text("from_int", lambda _s, _item, _padded: F.col("p_size").cast("string"), "CAST(p_size AS VARCHAR)")
_text("format_date", lambda _s, _item, _padded: F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), "strftime(ts, '%Y/%m/%d %H:%M:%S')", "events", "event_id")
_text("length", lambda _s, _item, _padded: F.length("text"), "CAST(length(text) AS INT)", "documents", "doc_id")
_text("substr_by_row", lambda _s, _item, _padded: F.substr(_s, F.pmod(F.col("p_partkey"), F.lit(5)).cast("int") + 1, F.pmod(F.col("p_size"), F.lit(7)).cast("int")), "substring(p_name, CAST(p_partkey % 5 AS INT) + 1, CAST(p_size % 7 AS INT))")
_text("like_escape", lambda _s, _item, _padded: text.like(F.concat("p_brand", F.lit("_50%")), "%\\_50\\%"), "p_brand || '_50%' LIKE '%!_50!%' ESCAPE '!'")
_text("like_other_escape", lambda _s, _item, _padded: text.like(F.concat("p_brand", F.lit("%")), "Brand!%_2!%%", "!"), "p_brand || '%' LIKE 'Brand!%_2!%%' ESCAPE '!'")
_text("code_points", lambda _s, _item, _padded: text.code_points(_item), "list_transform(CASE WHEN length(item) = 0 THEN [] ELSE regexp_extract_all(item, '(?s).') END, lambda c: CAST(unicode(c) AS INT))", "shop_items", "item_id")
_text("utf32_roundtrip", lambda _s, _item, _padded: text.from_code_points(text.code_points(_item)), "item", "shop_items", "item_id")
_text("from_float", lambda _s, _item, _padded: F.format_string("%.2f", "p_retailprice"), "format('{:.2f}', p_retailprice)")
_text("from_float_plain", lambda _s, _item, _padded: (F.col("p_size") / 4).cast("string"), "CAST(p_size / 4.0::DOUBLE AS VARCHAR)")
_add("text_merge_words", lambda s, d: text.merge(*(table(s, d, t).select(F.col(c).alias("word")) for t, c in {"nation": "n_name", "region": "r_name", "part": "p_brand", "supplier": "s_name"}.items())), "SELECT n_name AS word FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_brand FROM part UNION ALL SELECT s_name FROM supplier")
_q("text_remove_empty", "SELECT doc_id FROM documents WHERE length(text) > 0")


def _inferred(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the columns of a CSV file, inferred from all its lines."""
    path = _folder(spark)
    io.write(table(spark, d, "nums").select("ColA", "ColD", F.concat(F.lit("w"), F.col("ColD")).alias("w"), (F.col("ColA") > 2).alias("b"), F.make_date(F.lit(2024), F.lit(1), F.lit(1) + F.pmod(F.coalesce("ColD", F.lit(0)), F.lit(28)).cast("int")).alias("day")), path, "csv")
    found = spark.read.csv(path, header=True, inferSchema=True)
    return io.rows(spark, found.dtypes, "name string, kind string")


_add("text_infer_schema", _inferred, "SELECT * FROM (VALUES ('ColA', 'double'), ('ColD', 'int'), ('w', 'string'), ('b', 'boolean'), ('day', 'date')) AS v(name, kind)")

# ---- dates -----------------------------------------------------------------------------------------------------------


def _dt(name: str, columns, sql: str, tbl: str = "events", key: str = "event_id") -> None:
    cols = lambda: columns(F.col("ts"), F.col("o_orderdate"), F.lit("1999-03-31").cast("timestamp_ntz"))
    _on(f"dt_{name}", tbl, lambda t: t.select(key, *(c.alias(k) for k, c in cols().items())), f"SELECT {key}, {sql} FROM {tbl}")


_i = lambda parts: ", ".join(f"CAST({x} AS INT) AS {k}" for k, x in parts.items())
_dt("parts", lambda _ts, _od, _base: {"y": F.year(_ts), "m": F.month(_ts), "d": F.dayofmonth(_ts), "h": F.hour(_ts), "mi": F.minute(_ts), "s": F.second(_ts)}, _i({"y": "year(ts)", "m": "month(ts)", "d": "day(ts)", "h": "hour(ts)", "mi": "minute(ts)", "s": "second(ts)"}))
_dt("quarter_dow_doy_week", lambda _ts, _od, _base: {"q": F.quarter(_ts), "w": F.dayofweek(_ts), "y": F.dayofyear(_ts), "k": F.weekofyear(_ts)}, _i({"q": "quarter(ts)", "w": "dayofweek(ts) + 1", "y": "dayofyear(ts)", "k": "weekofyear(ts)"}))
_dt("make", lambda _ts, _od, _base: {"x": F.make_timestamp_ntz(F.year(_ts), F.month(_ts), F.dayofmonth(_ts), F.lit(1), F.lit(2), F.lit(3))}, "make_timestamp(year(ts), month(ts), day(ts), 1, 2, 3) AS x")
_dt("diffs", lambda _ts, _od, _base: {"d": F.datediff(_od, F.lit("1999-03-31").cast("date")), "m": dates.months_apart(_od, _base), "y": dates.years_apart(_od, _base)}, _i({"d": "datediff('day', DATE '1999-03-31', CAST(o_orderdate AS DATE))", "m": "datediff('month', DATE '1999-03-31', o_orderdate)", "y": "datediff('year', DATE '1999-03-31', o_orderdate)"}), "orders", "o_orderkey")
_dt("add_months", lambda _ts, _od, _base: {"x": F.add_months(_od, 1)}, "CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS x", "orders", "o_orderkey")
_dt("add_units", lambda _ts, _od, _base: {"s": (_ts + F.expr("INTERVAL '30' SECOND")), "h": (_ts + F.expr("INTERVAL '5' HOUR")), "d": (_ts - F.expr("INTERVAL '2' DAY"))}, "ts + INTERVAL 30 SECOND AS s, ts + INTERVAL 5 HOUR AS h, ts - INTERVAL 2 DAY AS d")
for _u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
    _dt(f"trunc_{_u}", lambda _ts, _od, _base, _u=_u: {"x": F.date_trunc(_u, _ts).cast("timestamp_ntz")}, f"CAST(date_trunc('{_u}', ts) AS TIMESTAMP) AS x")
_dt("next_day", lambda _ts, _od, _base: {"x": F.next_day(_od, "Mon")}, "CAST(CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INT) AS DATE) AS x", "orders", "o_orderkey")
_dt("last_day", lambda _ts, _od, _base: {"x": F.last_day(_od)}, "last_day(o_orderdate) AS x", "orders", "o_orderkey")
_on("dt_months_between", "orders", lambda t: t.select("o_orderkey", F.months_between("o_orderdate", F.lit("1999-03-31").cast("timestamp_ntz")).alias("x")),
    "SELECT o_orderkey, round(12 * (year(o_orderdate) - 1999) + month(o_orderdate) - 3 + CASE WHEN day(o_orderdate) = 31 OR CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN 0.0 ELSE (epoch(o_orderdate - date_trunc('day', o_orderdate)) + 86400 * (day(o_orderdate) - 31)) / 2678400.0 END::DOUBLE, 8) AS x FROM orders")
_dt("from_nanos", lambda _ts, _od, _base: {"x": dates.from_nanos(F.lit(1_700_000_000_123_456_789) + F.col("event_id")).cast("timestamp_ntz")}, "make_timestamp((1700000000123456789 + event_id) // 1000) AS x")
_dt("parse", lambda _ts, _od, _base: {"x": dates.parse(F.date_format(_ts, "dd.MM.yyyy HH:mm"), "dd.MM.yyyy HH:mm").cast("timestamp_ntz")}, "date_trunc('minute', ts) AS x")
_dt("unit_diffs", lambda _ts, _od, _base: {"h": dates.apart("hour", _ts, F.lit("2024-01-01").cast("timestamp_ntz")), "m": dates.apart("minute", _ts, F.lit("2024-01-01").cast("timestamp_ntz"))}, "datesub('hour', TIMESTAMP '2024-01-01', ts) AS h, datesub('minute', TIMESTAMP '2024-01-01', ts) AS m")
_N = lambda: F.lit(1_700_000_000_123_456_789)
_nanos = lambda: _N() + F.col("event_id") * 1_000_003_001
_nan_sql = "(1700000000123456789 + event_id * 1000003001)"
_dt("nanosecond", lambda _ts, _od, _base: {"x": dates.nanosecond(_nanos())}, f"CAST({_nan_sql} % 1000000000 AS INT) AS x")
_dt("nano_diffs", lambda _ts, _od, _base: {"ns": dates.nanos_apart("nanosecond", _nanos(), _N()), "us": dates.nanos_apart("microsecond", _nanos(), _N()), "ms": dates.nanos_apart("millisecond", _nanos(), _N()), "s": dates.nanos_apart("second", _nanos(), _N()), "back": dates.nanos_apart("minute", _N(), _nanos())}, "event_id * 1000003001 AS ns, event_id * 1000003001 // 1000 AS us, event_id * 1000003001 // 1000000 AS ms, event_id * 1000003001 // 1000000000 AS s, -(event_id * 1000003001 // 60000000000) AS back")
_dt("nano_add", lambda _ts, _od, _base: {"ns": dates.add_nanos(_nanos(), "nanosecond", 7), "w": dates.add_nanos(_nanos(), "week", -2)}, f"{_nan_sql} + 7 AS ns, {_nan_sql} - 1209600000000000 AS w")
for _u, _k in {"second": 90, "minute": 75, "hour": -30, "day": 40, "week": 3, "month": 13, "quarter": 1, "year": -1}.items():
    _dt(f"add_{_u}", lambda _ts, _od, _base, u=_u, k=_k: {"x": dates.add(_ts.cast("timestamp"), u, k).cast("timestamp_ntz")}, f"CAST(ts + INTERVAL ({_k * (3 if _u == 'quarter' else 1)}) {'MONTH' if _u == 'quarter' else _u.upper()} AS TIMESTAMP) AS x")
_dt("second_diff", lambda _ts, _od, _base: {"s": dates.apart("second", _ts, F.lit("2024-01-01").cast("timestamp_ntz")), "d": dates.apart("day", _ts, F.lit("2024-01-01").cast("timestamp_ntz")), "w": dates.apart("week", F.lit("2024-01-01").cast("timestamp_ntz"), _ts)}, "datesub('second', TIMESTAMP '2024-01-01', ts) AS s, datesub('day', TIMESTAMP '2024-01-01', ts) AS d, -datesub('week', TIMESTAMP '2024-01-01', ts) AS w")
_q("dt_between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN timestamp '1996-01-01 00:00:00' AND timestamp '1996-01-31 00:00:00'")

# ---- vectors ---------------------------------------------------------------------------------------------------------


def _vec(name: str, column, sql: str) -> None:
    if "round(" in sql:  # rounding may leave a negative zero
        sql = f"list_transform({sql}, lambda r: r + 0.0::DOUBLE)" if sql.startswith("list_") else f"{sql} + 0.0::DOUBLE"
    _on(f"vec_{name}", "embeddings", lambda t: t.select("vec_id", column(F.col("embedding")).alias("x")), f"SELECT vec_id, {sql} AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")


_r = lambda x: scalar.plain_zero(F.round(x, 5))
_rl = lambda x: F.transform(x, lambda y: scalar.plain_zero(F.round(y, 5)))
_vec("dot", lambda _v: _r(vectors.dot(_v, F.reverse(_v))), "round(list_dot_product(v, list_reverse(v)), 5)")
_vec("norm", lambda _v: _r(vectors.norm(_v)), "round(sqrt(list_dot_product(v, v)), 5)")
_vec("squared_sum", lambda _v: _r(vectors.squared_sum(_v)), "round(list_dot_product(v, v), 5)")
_vec("sum", lambda _v: _r(vectors.total(_v)), "round(list_sum(v), 5)")
_vec("mean", lambda _v: _r(vectors.mean(_v)), "round(list_avg(v), 5)")
_vec("squared_deviations", lambda _v: _r(vectors.squared_deviations(_v)), "round(list_var_pop(v) * len(v), 5)")
_vec("axpy", lambda _v: _rl(vectors.axpy(2.0, _v, F.reverse(_v))), "list_transform(range(1, len(v) + 1), lambda i: round(2 * v[i] + v[len(v) + 1 - i], 5))")
_vec("argmax", lambda _v: vectors.argmax(_v), "CAST(list_position(v, list_max(v)) - 1 AS BIGINT)")
_vec("argmin", lambda _v: vectors.argmin(_v), "CAST(list_position(v, list_min(v)) - 1 AS BIGINT)")
_vec("max_min", lambda _v: _r(F.array_max(_v).cast("double") - F.array_min(_v).cast("double")), "round(list_max(v) - list_min(v), 5)")
_vec("clip", lambda _v: _rl(vectors.each(_v, lambda x: scalar.clip(x, -0.1, 0.1))), "list_transform(v, lambda x: round(least(greatest(x, -0.1), 0.1), 5))")
_vec("logsumexp", lambda _v: _r(vectors.logsumexp(_v)), "round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 5)")
_vec("exp", lambda _v: _rl(vectors.each(_v, F.exp)), "list_transform(v, lambda x: round(exp(x), 5))")
_vec("multiply", lambda _v: _rl(vectors.both(_v, F.reverse(_v), lambda x, y: x * y)), "list_transform(range(1, len(v) + 1), lambda i: round(v[i] * v[len(v) + 1 - i], 5))")
_vec("subtract", lambda _v: _rl(vectors.both(_v, F.reverse(_v), lambda x, y: x - y)), "list_transform(range(1, len(v) + 1), lambda i: round(v[i] - v[len(v) + 1 - i], 5))")
_vec("count_positive", lambda _v: vectors.count_if(_v, lambda x: x > 0), "CAST(len(list_filter(v, lambda x: x > 0)) AS INT)")
_vec("binarize", lambda _v: vectors.each(_v, lambda x: scalar.binarize(x, 0.0)), "list_transform(v, lambda x: CAST(x > 0 AS INT))")
_vec("sorted", lambda _v: _rl(F.sort_array(_v.cast("array<double>"))), "list_transform(list_sort(v), lambda x: round(x, 5))")
_vec("take", lambda _v: _r(F.get(_v, 3).cast("double")), "round(v[4], 5)")
_vec("slice", lambda _v: _rl(F.slice(_v.cast("array<double>"), 2, 3)), "list_transform(v[2:4], lambda x: round(x, 5))")
_vec("reversed", lambda _v: _rl(F.reverse(_v.cast("array<double>"))), "list_transform(list_reverse(v), lambda x: round(x, 5))")
_d = lambda v: v.cast("array<double>")
_by = lambda f: lambda _v: _rl(vectors.both(_v, F.reverse(_v), f))
_each_sql = lambda x: f"list_transform(v, lambda x: round({x}, 5))"
_both_sql = lambda x: f"list_transform(range(1, len(v) + 1), lambda i: round({x.replace('y', 'v[len(v) + 1 - i]').replace('x', 'v[i]')}, 5))"
_vec("square", lambda _v: _rl(vectors.each(_v, lambda x: x * x)), _each_sql("x * x"))
_vec("sqrt", lambda _v: _rl(vectors.each(_v, lambda x: F.sqrt(F.abs(x)))), _each_sql("sqrt(abs(x))"))
_vec("log", lambda _v: _rl(vectors.each(_v, lambda x: F.log(F.abs(x) + 1))), _each_sql("ln(abs(x) + 1)"))
_vec("neg_log", lambda _v: _rl(vectors.each(_v, lambda x: -F.log(F.abs(x) + 1))), _each_sql("-ln(abs(x) + 1)"))
_vec("negative", lambda _v: _rl(vectors.each(_v, lambda x: -x)), _each_sql("-x"))
_vec("add", _by(lambda x, y: x + y), _both_sql("x + y"))
_vec("divide", _by(lambda x, y: scalar.safe_divide(x, y)), _both_sql("x / nullif(y, 0)"))
_vec("divide_by", lambda _v: _rl(vectors.each(_v, lambda x: scalar.safe_divide(x, F.lit(3.0)))), _each_sql("x / 3.0"))
_vec("fdiv", lambda _v: _rl(F.transform(_v, lambda x: F.floor(x.cast("double") * 100) / F.lit(7.0))), _each_sql("floor(x * 100) / 7.0"))
_vec("idiv", lambda _v: F.transform(_v, lambda x: F.call_function("div", F.floor(x.cast("double") * 100), F.lit(7)).cast("bigint")), "list_transform(v, lambda x: CAST(trunc(floor(x * 100) / 7) AS BIGINT))")
_vec("mod", lambda _v: F.transform(_v, lambda x: scalar.safe_mod(F.floor(x.cast("double") * 100), F.lit(7)).cast("bigint")), "list_transform(v, lambda x: CAST(floor(x * 100) AS BIGINT) % 7)")
_vec("pow", lambda _v: _rl(vectors.each(_v, lambda x: F.pow(x, F.lit(3.0)))), _each_sql("pow(x, 3)"))
_vec("scaled_sum", lambda _v: _r(vectors.scaled_sum(_v, 2.5)), "round(list_sum(list_transform(v, lambda x: x * 2.5)), 5)")
_vec("amax", lambda _v: _r(F.array_max(_d(_v))), "round(list_max(v), 5)")
_vec("amin", lambda _v: _r(F.array_min(_d(_v))), "round(list_min(v), 5)")
_vec("concat", lambda _v: _rl(F.concat(_d(_v), F.slice(_d(_v), 1, 2))), "list_transform(list_concat(v, v[1:2]), lambda x: round(x, 5))")
_vec("take_places", lambda _v: _rl(F.transform(F.array(F.lit(0), F.lit(2), F.lit(2), F.lit(5)), lambda i: F.get(_d(_v), i))), "list_transform([1, 3, 3, 6], lambda i: round(v[i], 5))")
_vec("smaller", lambda _v: _rl(vectors.smaller(_d(_v), F.reverse(_d(_v)))), _both_sql("least(x, y)"))
_vec("larger", lambda _v: _rl(vectors.larger(_d(_v), F.reverse(_d(_v)))), _both_sql("greatest(x, y)"))
_vec("is_same", lambda _v: F.array(_d(_v) == _d(_v), _d(_v) == F.reverse(_d(_v))), "[true, v = list_reverse(v)]")
_vec("is_uniform", lambda _v: F.array(vectors.is_uniform(_d(_v)), vectors.is_uniform(vectors.full(F.size(_v), 1.5))), "[len(list_distinct(v)) <= 1, true]")
_vec("arrange", lambda _v: vectors.arrange(F.lit(2).cast("bigint"), F.size(_v).cast("bigint"), 3), "range(2, len(v), 3)")
_vec("arrange_down", lambda _v: vectors.arrange(F.size(_v).cast("bigint"), F.lit(0).cast("bigint"), -5), "range(len(v), 0, -5)")
_vec("zeros", lambda _v: vectors.full(F.size(_v), 0.0), "list_transform(v, lambda x: 0.0::DOUBLE)")
_vec("ones", lambda _v: vectors.full(F.size(_v), 1.0), "list_transform(v, lambda x: 1.0::DOUBLE)")
_vec("full", lambda _v: vectors.full(F.size(_v), F.col("vec_id").cast("double")), "list_transform(v, lambda x: CAST(vec_id AS DOUBLE))")
_vec("order", lambda _v: vectors.order(_d(_v)), "list_transform(list_sort(list_transform(range(1, len(v) + 1), lambda i: {'x': v[i], 'i': i - 1})), lambda s: CAST(s.i AS INT))")
_vec("encode_unique", lambda _v: vectors.encode_unique(F.transform(_v, lambda x: F.floor(x.cast("double") * 10))), "list_transform(list_transform(v, lambda x: floor(x * 10)), lambda y: CAST(list_position(list_sort(list_distinct(list_transform(v, lambda x: floor(x * 10)))), y) - 1 AS INT))")
_vec("contains", lambda _v: F.array(F.exists(_v, lambda x: F.floor(x.cast("double") * 10) == 0), F.exists(_v, lambda x: x > 1e9)), "[list_contains(list_transform(v, lambda x: floor(x * 10)), 0), false]")
for _n, (_f, _x) in {"nonzero": (lambda x: F.floor(x * 10) != 0, "floor(x * 10) <> 0"), "equal": (lambda x: F.floor(x * 10) == 1, "floor(x * 10) = 1"), "negative": (lambda x: x < 0, "x < 0"), "infinite": (lambda x: scalar.is_infinite(x) | F.isnan(x), "NOT isfinite(x)"), "out_of_range": (lambda x: (x < -0.1) | (x > 0.1), "x < -0.1 OR x > 0.1")}.items():
    _vec(f"count_{_n}", lambda _v, f=_f: vectors.count_if(_d(_v), f), f"CAST(len(list_filter(v, lambda x: {_x})) AS INT)")
for _n, (_f, _x) in {"lt": (lambda x: x < 0.05, "x < 0.05"), "le": (lambda x: x <= 0.05, "x <= 0.05"), "gt": (lambda x: x > 0.05, "x > 0.05"), "ge": (lambda x: x >= 0.05, "x >= 0.05"), "eq": (lambda x: F.floor(x * 10) == 1, "floor(x * 10) = 1"), "ne": (lambda x: F.floor(x * 10) != 1, "floor(x * 10) <> 1"), "between": (lambda x: (x > -0.05) & (x < 0.05), "x > -0.05 AND x < 0.05"), "beyond": (lambda x: (x <= -0.05) | (x >= 0.05), "x <= -0.05 OR x >= 0.05")}.items():
    _vec(f"find_{_n}", lambda _v, f=_f: vectors.places(_d(_v), f), f"list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN {_x.replace('x', 'v[i]')} THEN CAST(i - 1 AS INT) END), lambda i: i IS NOT NULL)")
_on("vec_find_one", "nums", lambda t: t.agg(*(F.count_if(x).alias(k) for k, x in {"one": F.col("ColA") == 1, "zero_or_one": F.col("ColA").isin(0.0, 1.0), "largest": F.col("ColD") == 32767, "smallest": F.col("ColD") == -32768}.items())), "SELECT count(*) FILTER (WHERE ColA = 1) AS one, count(*) FILTER (WHERE ColA IN (0, 1)) AS zero_or_one, count(*) FILTER (WHERE ColD = 32767) AS largest, count(*) FILTER (WHERE ColD = -32768) AS smallest FROM nums")
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_key, _order = ["user_id"], ["ts", "event_id"]
_on("vec_prefix_sum", "events", lambda t: ordered.prefix_sum(t, _key, _order, F.col("value"), "x").select("event_id", F.round("x", 4).alias("x")), "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS x FROM events")
_on("vec_shift", "events", lambda t: ordered.shift(t, _key, _order, F.col("event_type"), 1, "x").select("event_id", "x"), f"SELECT event_id, lag(event_type) OVER {_W} AS x FROM events")
_on("vec_shift_back", "events", lambda t: ordered.shift(t, _key, _order, F.col("event_type"), -2, "x").select("event_id", "x"), f"SELECT event_id, lead(event_type, 2) OVER {_W} AS x FROM events")
_on("vec_ffill", "events", lambda t: ordered.forward_fill(t, _key, _order, F.when(F.col("event_type") == "purchase", F.col("event_id")), "x").select("event_id", "x"), "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS x FROM events")
_on("vec_numbered", "events", lambda t: ordered.numbered(t, _key, _order, "n").select("event_id", "n"), f"SELECT event_id, row_number() OVER {_W} AS n FROM events")
_on("vec_bincount", "part", lambda t: t.groupBy("p_size").agg(F.count(F.lit(1)).alias("n")), "SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
_on("vec_predicates", "xy_points", lambda t: t.agg(*(F.count_if(x).alias(k) for k, x in {"nan": F.isnan("double_x"), "zero": F.col("double_x") == 0, "pos": (F.col("double_x") > 0) & ~F.isnan("double_x"), "neg": F.col("double_x") < 0, "null_": F.col("double_x").isNull(), "inf": scalar.is_infinite(F.col("double_x"))}.items())), "SELECT count(*) FILTER (WHERE isnan(double_x)) AS nan, count(*) FILTER (WHERE double_x = 0) AS zero, count(*) FILTER (WHERE double_x > 0 AND NOT isnan(double_x)) AS pos, count(*) FILTER (WHERE double_x < 0) AS neg, count(*) FILTER (WHERE double_x IS NULL) AS null_, count(*) FILTER (WHERE isinf(double_x)) AS inf FROM xy_points")

# ---- example scripts: aggregates over the columns _1, _2, _3 of a CSV file without a header ----------------------------


def _script(name: str, columns: str, view: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = _folder(spark)
        io.write(table(spark, d, "nums").select("ColA", "ColB", "ColC"), path, "csv", header="false")
        read = io.csv(spark, path, "_1 double, _2 double, _3 double", header=False)
        if not view:
            return read.selectExpr(*columns.split("; "))
        read.createOrReplaceTempView("script")
        return spark.sql(f"SELECT {columns.replace('; ', ', ')} FROM script")

    _add(f"script_{name}", run, f"SELECT {columns.replace('; ', ', ')} FROM (SELECT ColA AS _1, ColB AS _2, ColC AS _3 FROM nums)")


_script("add_pairwise", "_1 + _2 AS s")
_script("avg", "round(avg(_1), 6) AS a", view=True)
_script("avg_multiple", "round(avg(_1), 6) AS a; round(avg(_2), 6) AS b; round(avg(_3), 6) AS c")
_script("sum", "round(sum(_1), 4) AS a", view=True)
_script("sum_multiple", "round(sum(_1), 4) AS a; round(sum(_2), 4) AS b; round(sum(_3), 4) AS c")
_script("multiple_operations", "round(avg(_2 - _1), 6) AS a; round(sum(2 + _2), 4) AS b; round(sum(_3), 4) AS c")

# ---- benchmark queries -----------------------------------------------------------------------------------------------

for _n, _x in {"avg_x": "avg(double_x)", "avg_x_plus_y": "avg(double_x + double_y)", "sum_x": "sum(double_x)", "sum_x_plus_y": "sum(double_x + double_y)"}.items():
    _q(f"bench_{_n}", f"SELECT {_nan(_x, 'x', 4)} FROM xy_points")
_q("bench_x_plus_y", f"SELECT {_nan('double_x + double_y', 'x', 6)} FROM xy_points")
_ten = "CAST(floor(id / 10) AS BIGINT)"
for _n, _x in {"sum_x": "sum(double_x)", "avg_x": "avg(double_x)", "sum_x_plus_y": "sum(double_x + double_y)", "avg_x_plus_y": "avg(double_x + double_y)", "sum_x_minus_y": "sum(double_x - double_y)"}.items():
    _q(f"bench_group_{_n}", f"SELECT {_ten} AS g, {_nan(_x, 'x', 4)} FROM xy_points GROUP BY {_ten}")
_q("bench_group_count", f"SELECT {_ten} AS g, count(*) AS n FROM xy_points GROUP BY {_ten}")
_q("bench_group_having", f"SELECT {_ten} AS g, {_nan('sum(double_x + double_y)', 'res', 4)} FROM xy_points GROUP BY {_ten} HAVING sum(double_x + double_y) > 10")
_loc = "pickup_location_id, dropoff_location_id, payment_type"
_q("bench_taxi_q1", "SELECT pickup_datetime, dropoff_datetime, fare_amount, pickup_location_id, dropoff_location_id FROM trips WHERE payment_type = 2 GROUP BY pickup_datetime, dropoff_datetime, fare_amount, pickup_location_id, dropoff_location_id HAVING fare_amount > 20.0")
_q("bench_taxi_q2", f"SELECT {_loc}, count(*) AS n, round(avg(fare_amount), 8) AS fare FROM trips GROUP BY {_loc}")
_q("bench_taxi_q3", f"SELECT {_loc}, count(*) AS n, round(sum(total_amount), 4) AS total FROM trips GROUP BY {_loc} HAVING sum(fare_amount + extra) < 0")
_q("bench_taxi_q4", "SELECT trips.payment_type, trips.fare_amount, trips.mta_tax, trips.trip_distance, trips.tolls_amount, cab_types.type FROM trips INNER JOIN cab_types ON trips.cab_type_id = cab_types.id")
_dist, _total = "CASE WHEN total_amount IS NOT NULL THEN trip_distance END", "CASE WHEN trip_distance IS NOT NULL THEN total_amount END"
_varies = f"min({_dist}) < max({_dist}) AND min({_total}) < max({_total})"  # else there is no correlation
for _n, _k in {"q5": "pickup_location_id", "q6": "payment_type", "q7": "dropoff_location_id"}.items():
    _on(f"bench_taxi_{_n}", "trips", lambda t, k=_k: t.groupBy(k).agg(
        F.when(F.expr(_varies), F.round(scalar.safe_corr(F.col("trip_distance"), F.col("total_amount")), 6)).alias("correlation"), F.round(F.avg("trip_distance"), 8).alias("mean_distance"), F.round(F.avg("total_amount"), 8).alias("mean_amount")),
        f"SELECT {_k}, CASE WHEN {_varies} THEN round(corr(trip_distance, total_amount), 6) END AS correlation, round(avg(trip_distance), 8) AS mean_distance, round(avg(total_amount), 8) AS mean_amount FROM trips GROUP BY {_k}")

# ---- streaming -------------------------------------------------------------------------------------------------------


def _steps(spark: SparkSession, d: str, parts: int = 4) -> str:
    """The events in files by time, read as one micro-batch each, so that state goes from batch to batch."""
    path = _folder(spark)
    table(spark, d, "events").repartitionByRange(parts, "ts", "event_id").write.parquet(path)
    return path


def _stream(name: str, make, mode: str, sql: str, after=lambda x: x) -> None:
    _add(f"stream_{name}", lambda spark, d: after(streams.run_to_end(make(streams.stream_of(spark, _steps(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))), mode)), sql)


_stream("group_count", lambda s: streams.count_by(s, "event_type"), "complete", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
# In update mode every batch gives the keys that changed; the last word on a key is its highest count.
_stream("group_update", lambda s: streams.count_by(s, "user_id"), "update", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id", lambda x: x.groupBy("user_id").agg(F.max("n").alias("n")))
_stream("filter_project", lambda s: s.where("value > 50").select("event_id", "event_type"), "append", "SELECT event_id, event_type FROM events WHERE value > 50")
_stream("windowed", lambda s: streams.windowed(s, "ts", "1 day", "1 day", "event_type"), "complete", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", lambda x: x.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"))
_stream("first_seen", lambda s: streams.first_seen(s, "ts", "60 days", "user_id").select("user_id"), "append", "SELECT DISTINCT user_id FROM events")


def _steps_seen(spark: SparkSession, d: str) -> DataFrame:
    """How many micro-batches there were, and in how many of them keys of earlier ones changed."""
    out = streams.run_to_end(streams.count_by(streams.stream_of(spark, _steps(spark, d)), "event_type"), "update", "step")
    return out.agg(F.count_distinct("step").alias("steps"), (F.count(F.lit(1)) > F.count_distinct("event_type")).alias("again"))


def _rate(spark: SparkSession, d: str) -> DataFrame:
    """A generated stream through SQL in update mode: numbers by their last digit, as far as two batches go."""
    io.rate_batches(spark, 1000).createOrReplaceTempView("ticks")
    out = streams.run_batches(spark.sql("SELECT value % 10 AS bar, count(*) AS n FROM ticks GROUP BY value % 10"), "update", 2)
    return out.groupBy("bar").agg(F.max("n").alias("n"))


def _clock(spark: SparkSession, d: str) -> DataFrame:
    """The clock-driven source: its numbers come once each and without gaps."""
    out = streams.run_batches(io.rate(spark, 50), "append", 4)
    return out.agg((F.count(F.lit(1)) == F.count_distinct("value")).alias("once"), (F.coalesce(F.max("value") + 1, F.lit(0)) == F.count(F.lit(1))).alias("whole"))


def _memory(spark: SparkSession, d: str) -> DataFrame:
    return streams.to_memory(streams.count_by(streams.stream_of(spark, _steps(spark, d)), "event_type"), "complete")


_add("stream_steps", _steps_seen, "SELECT CAST(4 AS BIGINT) AS steps, true AS again")
_add("stream_rate_update", _rate, "SELECT i % 10 AS bar, count(*) AS n FROM range(0, 2000) t(i) GROUP BY i % 10")
_add("stream_rate", _clock, "SELECT true AS once, true AS whole")
_add("stream_memory_sink", _memory, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")

# ---- extensions: what Spark gives beyond the inventory ---------------------------------------------------------------

_q("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_q("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_q("ext_window_rank", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r FROM supplier", "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS INT) AS r FROM supplier")
_on("ext_pivot", "lineitem", lambda t: t.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))), "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY l_returnflag")
_q("ext_session_window", "SELECT user_id, count(*) AS n, session_window.start AS s FROM events GROUP BY user_id, session_window(ts, '1 hour')", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, min(ts) AS s FROM h GROUP BY user_id, k")
