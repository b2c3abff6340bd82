"""TPC-H queries on the tables at hand. Those that need columns or literals the tables lack are named *_variant."""

from __future__ import annotations

from brindle.plans.sql import Book

_book = Book()
QUERIES, SQL = _book.queries, _book.sql
_q = _book.text

#: Stands in for the missing table: supplied parts with a cost and a quantity.
_PARTSUPP = "partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"

_q("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")

_q("tpch_q2_variant", f"""
WITH {_PARTSUPP}, eu AS (SELECT ps_partkey, s_acctbal, s_name, n_name, ps_supplycost FROM partsupp JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part JOIN eu ON p_partkey = ps_partkey
WHERE p_size < 20 AND p_type LIKE '%M%' AND ps_supplycost = (SELECT min(e.ps_supplycost) FROM eu e WHERE e.ps_partkey = p_partkey)""")

_q("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < timestamp '1997-03-15 00:00:00' AND l_shipdate > timestamp '1997-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate""")

_q("tpch_q4_variant", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= timestamp '1996-07-01 00:00:00' AND o_orderdate < timestamp '1996-10-01 00:00:00'
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority ORDER BY o_orderpriority""")

_q("tpch_q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= timestamp '1996-01-01 00:00:00' AND o_orderdate < timestamp '1997-01-01 00:00:00'
GROUP BY n_name ORDER BY revenue DESC""")

_q("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= timestamp '1996-01-01 00:00:00' AND l_shipdate < timestamp '1997-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")

_q("tpch_q7", """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_8') OR (n1.n_name = 'NATION_8' AND n2.n_name = 'NATION_7'))
    AND l_shipdate BETWEEN timestamp '1995-01-01 00:00:00' AND timestamp '1996-12-31 00:00:00') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")

_q("tpch_q8", """
SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN timestamp '1995-01-01 00:00:00' AND timestamp '1996-12-31 00:00:00' AND p_type = 'ECONOMY') AS all_nations
GROUP BY o_year ORDER BY o_year""")

_q("tpch_q9_variant", f"""
WITH {_PARTSUPP}
SELECT n_name AS nation_name, CAST(year(o_orderdate) AS INT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity / 100), 4) AS sum_profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%a%' GROUP BY n_name, CAST(year(o_orderdate) AS INT) ORDER BY nation_name, o_year DESC""")

_q("tpch_q10", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= timestamp '1995-10-01 00:00:00' AND o_orderdate < timestamp '1996-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey""")

_q("tpch_q11_variant", f"""
WITH {_PARTSUPP}, local_parts AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS worth FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')
SELECT ps_partkey, round(sum(worth), 2) AS part_value FROM local_parts GROUP BY ps_partkey HAVING sum(worth) > (SELECT sum(worth) * 0.002 FROM local_parts) ORDER BY part_value DESC, ps_partkey""")

_q("tpch_q12_variant", """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= timestamp '1996-01-01 00:00:00' AND l_shipdate < timestamp '1997-01-01 00:00:00'
GROUP BY l_returnflag ORDER BY l_returnflag""")

_q("tpch_q13_variant", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")

_q("tpch_q14", """
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= timestamp '1995-09-01 00:00:00' AND l_shipdate < timestamp '1995-10-01 00:00:00'""")

_q("tpch_q15", """
WITH revenue1 (supplier_no, total_revenue) AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) FROM lineitem
  WHERE l_shipdate >= timestamp '1996-01-01 00:00:00' AND l_shipdate < timestamp '1996-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue1 ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue1) ORDER BY s_suppkey""")

_q("tpch_q16_variant", f"""
WITH {_PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#12' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")

_q("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.4 * avg(l.l_quantity) FROM lineitem l WHERE l.l_partkey = p_partkey)""")

_q("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey""")

_q("tpch_q19", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 25)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#5' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""")

_q("tpch_q20_variant", f"""
WITH {_PARTSUPP}
SELECT s_name, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_regionkey = 2 AND s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'a%' OR p_name LIKE 's%')
  AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= timestamp '1996-01-01 00:00:00' AND l_shipdate < timestamp '1997-01-01 00:00:00'))
ORDER BY s_name""")

_q("tpch_q21_variant", """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate)
GROUP BY s_name ORDER BY numwait DESC, s_name""")

_q("tpch_q22_variant", """
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT substring(c_mktsegment FROM 1 FOR 2) AS cntrycode, c_acctbal FROM customer
  WHERE substring(c_mktsegment FROM 1 FOR 2) IN ('AU', 'BU', 'FU') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
    AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= timestamp '1998-01-01 00:00:00')) AS custsale
GROUP BY cntrycode ORDER BY cntrycode""")
