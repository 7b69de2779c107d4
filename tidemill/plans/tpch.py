"""TPC-H shapes over the reduced schema; both engines read the same text."""

from __future__ import annotations

from tidemill.plans.subqueries import sql

_REV = "sum(l_extendedprice * (1 - l_discount))"

sql("tpch_q1", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql("tpch_q3", "customer orders lineitem", f"SELECT l_orderkey, round({_REV}, 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
sql("tpch_q4", "orders lineitem", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
sql("tpch_q5", "customer orders lineitem supplier nation region", f"SELECT n_name, round({_REV}, 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name")
sql("tpch_q6", "lineitem", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql("tpch_q7", "supplier lineitem orders customer nation", f"SELECT n1.n_name AS supp, n2.n_name AS cust, extract(YEAR FROM l_shipdate) AS y, round({_REV}, 2) AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_nationkey < n2.n_nationkey AND n1.n_regionkey = n2.n_regionkey GROUP BY n1.n_name, n2.n_name, extract(YEAR FROM l_shipdate)")
sql("tpch_q9", "part supplier lineitem orders nation", "SELECT n_name, extract(YEAR FROM o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount) - 0.5 * l_quantity), 2) AS profit FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_size < 20 GROUP BY n_name, extract(YEAR FROM o_orderdate)")
sql("tpch_q10", "customer orders lineitem nation", f"SELECT c_custkey, c_name, round({_REV}, 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
sql("tpch_q11", "lineitem supplier nation", "SELECT l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2)")
sql("tpch_q12", "orders lineitem", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_linestatus")
sql("tpch_q13", "customer orders", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) t GROUP BY c_count")
sql("tpch_q14", "lineitem part", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / {_REV}, 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'")
sql("tpch_q15", "lineitem supplier", f"WITH revenue AS (SELECT l_suppkey AS k, {_REV} AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_suppkey) SELECT s_suppkey, s_name, round(total, 2) AS total FROM supplier, revenue WHERE s_suppkey = k AND total >= (SELECT max(total) FROM revenue) * 0.9")
sql("tpch_q16", "lineitem part supplier", "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS n FROM lineitem, part WHERE p_partkey = l_partkey AND p_size IN (1, 5, 9, 14, 19, 23) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size")
sql("tpch_q17", "lineitem part", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 10 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)")
sql("tpch_q18", "customer orders lineitem", "SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
sql("tpch_q19", "lineitem part", f"SELECT round({_REV}, 2) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30))")
sql("tpch_q20", "supplier nation lineitem part", "SELECT s_name FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY l_suppkey HAVING sum(l_quantity) > 100) AND s_nationkey = n_nationkey AND n_regionkey = 1")
sql("tpch_q21", "supplier lineitem orders nation", "SELECT s_name, count(*) AS n FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') AND s_nationkey = n_nationkey GROUP BY s_name")
sql("tpch_q22", "customer orders", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_nationkey")
sql("tpch_q2", "part supplier lineitem nation region", "WITH offers AS (SELECT l_partkey AS pk, l_suppkey AS sk, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey), near AS (SELECT pk, sk, cost, s_name, s_acctbal, n_name FROM offers, supplier, nation, region WHERE sk = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE') SELECT s_acctbal, s_name, n_name, p_partkey, round(cost, 4) AS cost FROM near, part WHERE p_partkey = pk AND p_size < 15 AND cost = (SELECT min(cost) FROM near n2 WHERE n2.pk = p_partkey)")
sql("tpch_q8", "part supplier lineitem orders customer nation region", "SELECT extract(YEAR FROM o_orderdate) AS y, round(sum(CASE WHEN n2.n_nationkey = 2 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey GROUP BY extract(YEAR FROM o_orderdate)")
