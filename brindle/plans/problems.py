"""Queries pN_ of the core: problems 1, 2 and 4 of TESTDATA.md on the shop tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.keyed import heavy_keys, per_key
from brindle.operators.packed import split_packed
from brindle.operators.rolling import trailing_extremes, trailing_totals
from brindle.session import table

#: Numbers from here on are milliseconds (as seconds they would lie beyond the year 5000).
MILLIS_FROM = 100_000_000_000
PERIODS = [7, 30]


def epoch_day(ts: Column) -> Column:
    """UTC day number of a time in seconds or milliseconds; null for null and for 0 (unknown)."""
    seconds = F.when(F.abs(ts) >= MILLIS_FROM, F.floor(ts / 1000)).otherwise(ts)
    return F.when(ts != 0, F.floor(seconds / 86400)).cast("int")


def order_days(orders: DataFrame) -> DataFrame:
    """(userId, day, cents) of each order once. All deliveries of an id agree, so any known value is the value."""
    once = orders.groupBy("id").agg(F.max("userId").alias("userId"), F.max("orderTimestamp").alias("ts"), F.max("totalPrice").alias("price"))
    return once.select("userId", epoch_day(F.col("ts")).alias("day"), F.round(F.col("price") * 100).cast("long").alias("cents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "shop_orders"), "items", [], key="id").select("id", "pos", "item")


def p1_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The values of every delivered row, not only of every order."""
    return split_packed(table(spark, d, "shop_orders"), "items", ["id", "loaded_at"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = trailing_extremes(order_days(table(spark, d, "shop_orders")), "userId", "day", "cents", PERIODS)
    cases = F.explode(F.array(F.struct(F.lit("high").alias("extreme"), F.col("high_day").alias("day")), F.struct(F.lit("low").alias("extreme"), F.col("low_day").alias("day"))))
    return x.select("userId", F.col("period").alias("period_days"), cases.alias("c")).select("userId", "period_days", "c.extreme", F.date_format(F.date_from_unix_date("c.day"), "yyyy-MM-dd").alias("order_day"))


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals (whole cents) and daily averages of the trailing 7 and 30 days, of every user and day."""
    x = trailing_totals(order_days(table(spark, d, "shop_orders")), "userId", "day", "cents", PERIODS)
    cents = [F.col(c).cast("long").alias(c) for c in ("total", "total_7", "total_30")]
    return x.select("userId", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("order_day"), *cents, F.round("avg_7", 4).alias("avg_7"), F.round("avg_30", 4).alias("avg_30"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "shop_orders"), "userId", 50).select("userId")


def p4_per_user(spark: SparkSession, d: str) -> DataFrame:
    x = per_key(table(spark, d, "shop_orders"), "userId", "id", "totalPrice", items="n_orders", total="row_price", item_total="order_price")
    return x.select("userId", "n_rows", "n_orders", F.round("row_price", 2).alias("row_price"), F.round("order_price", 2).alias("order_price"))


_DAYS = """
WITH once AS (SELECT id, max(userId) u, max(orderTimestamp) ts, max(totalPrice) p FROM shop_orders GROUP BY id),
o AS (SELECT u, CAST(floor((CASE WHEN abs(ts) >= 100000000000 THEN floor(ts / 1000) ELSE ts END) / 86400) AS INTEGER) d, CAST(round(p * 100) AS BIGINT) c
      FROM once WHERE u IS NOT NULL AND ts IS NOT NULL AND ts <> 0 AND p IS NOT NULL),
daily AS (SELECT u, d, CAST(sum(c) AS BIGINT) c FROM o GROUP BY u, d),
span AS (SELECT u, min(d) f, max(d) l FROM daily GROUP BY u),
grid AS (SELECT s.u, s.f, s.l, CAST(g.d AS INTEGER) d FROM span s, LATERAL (SELECT unnest(generate_series(s.f, s.l)) d) g),
dense AS (SELECT g.u, g.f, g.l, g.d, coalesce(daily.c, 0) c FROM grid g LEFT JOIN daily ON daily.u = g.u AND daily.d = g.d),
roll AS (SELECT u, f, l, d, c,
           CAST(sum(c) OVER (PARTITION BY u ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) t7,
           CAST(sum(c) OVER (PARTITION BY u ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) t30
         FROM dense)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_deliveries, p2_found, p2_rolling, p4_found, p4_per_user)}

SQL = {
    "p2_found": _DAYS
    + """, p AS (SELECT u, d, 7 period, t7 t FROM roll WHERE d >= f + 6 UNION ALL SELECT u, d, 30, t30 FROM roll WHERE d >= f + 29),
r AS (SELECT *, row_number() OVER (PARTITION BY u, period ORDER BY t DESC, d) hi, row_number() OVER (PARTITION BY u, period ORDER BY t, d) lo FROM p)
SELECT u AS "userId", CAST(period AS INTEGER) AS period_days, 'high' AS extreme, strftime(DATE '1970-01-01' + d, '%Y-%m-%d') AS order_day FROM r WHERE hi = 1
UNION ALL SELECT u, CAST(period AS INTEGER), 'low', strftime(DATE '1970-01-01' + d, '%Y-%m-%d') FROM r WHERE lo = 1""",
    "p2_rolling": _DAYS
    + """SELECT u AS "userId", strftime(DATE '1970-01-01' + d, '%Y-%m-%d') AS order_day, c AS total, t7 AS total_7, t30 AS total_30,
       round(t7 / 7.0::DOUBLE, 4) AS avg_7, round(t30 / 30.0::DOUBLE, 4) AS avg_30 FROM roll""",
    "p4_found": """SELECT "userId" FROM shop_orders WHERE "userId" IS NOT NULL GROUP BY "userId" HAVING count(*) * 50 >= (SELECT count(*) FROM shop_orders)""",
    "p4_per_user": """WITH i AS (SELECT "userId" u, id, count(*) n, sum("totalPrice") s, max("totalPrice") m FROM shop_orders GROUP BY "userId", id)
SELECT u AS "userId", CAST(sum(n) AS BIGINT) AS n_rows, count(id) AS n_orders, round(sum(s), 2) AS row_price, round(sum(CASE WHEN id IS NOT NULL THEN m END), 2) AS order_price FROM i GROUP BY u""",
}
