"""Subqueries, common table expressions, recursion, set-returning and nested data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemill.operators import recursion
from tidemill.plans.registry import query
from tidemill.session import register, table


def sql(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """A query whose text both engines read (or has its own oracle)."""

    def build(spark, sf):
        register(spark, sf, tables.split())
        return spark.sql(text)

    query(name, oracle or text)(build)


sql("sub_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
sql("sub_scalar_select", "nation region", "SELECT n_name, (SELECT max(r_name) FROM region) AS top FROM nation")
sql("sub_correlated", "orders", "SELECT o_orderkey FROM orders a WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)")
sql("sub_exists", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql("sub_in_correlated", "lineitem orders", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_orderkey = o_orderkey)")
sql(
    "sub_any_all", "supplier", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = 3) AND s_acctbal > (SELECT min(s_acctbal) FROM supplier)",
    "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3) AND s_acctbal > ANY (SELECT s_acctbal FROM supplier)",
)
sql("sub_lateral", "customer orders", "SELECT c_custkey, t.top FROM customer, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) t")
sql("sub_derived", "orders", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
sql("sub_row_in", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7)")
sql("cte_plain", "orders customer", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), rich AS (SELECT * FROM big WHERE t > 1000000) SELECT c_name, round(t, 2) AS t FROM rich JOIN customer ON o_custkey = c_custkey")
sql("cte_recursive", "region", "WITH RECURSIVE r(n, f) AS (SELECT 1 AS n, CAST(1 AS BIGINT) AS f UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
sql("cte_recursive_graph", "nation", "WITH RECURSIVE walk(k, depth) AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, w.depth + 1 FROM walk w JOIN nation n ON n.n_nationkey = w.k * 2 + 1 OR n.n_nationkey = w.k * 2 + 2) SELECT k, depth FROM walk")
sql("cte_recursive_limit", "region", "WITH RECURSIVE r(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 100) SELECT count(*) AS c, max(n) AS m FROM r")


@query(
    "recursive_fixpoint",
    "WITH RECURSIVE reach(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation UNION SELECT r.a, n.n_regionkey FROM reach r JOIN nation n ON n.n_nationkey = r.b) SELECT a, b FROM reach",
)
def recursive_fixpoint(spark, sf):
    edges = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    step = lambda last: last.select("a", F.col("b").alias("via")).join(edges.select(F.col("a").alias("via"), F.col("b").alias("to")), "via").select("a", "to")
    return recursion.recursive(edges, step, distinct=True)


# --- arrays, maps, multisets, table functions ---------------------------------------

sql("nested_array_query", "nation", "SELECT n_regionkey, sort_array(collect_list(n_nationkey)) AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS ks FROM nation GROUP BY n_regionkey")
sql("nested_unnest", "nation", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(array(n_nationkey, n_regionkey)) t AS x", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x FROM nation")
sql("nested_unnest_ordinal", "nation", "SELECT n_nationkey, CAST(i + 1 AS BIGINT) AS i, part FROM nation LATERAL VIEW posexplode(split(n_name, '_')) t AS i, part", "SELECT n_nationkey, i, parts[i] AS part FROM (SELECT n_nationkey, string_split(n_name, '_') AS parts, unnest(range(1, len(string_split(n_name, '_')) + 1)) AS i FROM nation)")
sql("nested_member_of", "nation", "SELECT n_nationkey FROM nation WHERE array_contains(array(1, 3, 5, 7), n_nationkey)", "SELECT n_nationkey FROM nation WHERE list_contains([1, 3, 5, 7], n_nationkey)")
sql(
    "nested_multiset_ops", "nation",
    "SELECT n_nationkey, sort_array(array_union(array(1, 2, n_nationkey), array(2, 3))) AS u, sort_array(array_intersect(array(1, 2, n_nationkey), array(2, 3))) AS i, sort_array(array_except(array(1, 2, n_nationkey), array(2, 3))) AS e FROM nation",
    "SELECT n_nationkey, list_sort(list_distinct([1, 2, n_nationkey, 2, 3])) AS u, list_sort(list_distinct(list_intersect([1, 2, n_nationkey], [2, 3]))) AS i, list_sort(list_distinct(list_filter([1, 2, n_nationkey], lambda x: x NOT IN (2, 3)))) AS e FROM nation",
)
sql("nested_map", "nation", "SELECT n_nationkey, map('k', n_nationkey, 'r', n_regionkey)['r'] AS r, CAST(size(map('k', 1)) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, map(['k', 'r'], [n_nationkey, n_regionkey])['r'] AS r, 1::BIGINT AS n FROM nation")
sql("nested_map_query", "nation", "SELECT n_regionkey, map_from_entries(collect_list(struct(n_nationkey, n_name)))[CAST(n_regionkey AS INT)] AS own FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, max(n_name) FILTER (WHERE n_nationkey = n_regionkey) AS own FROM nation GROUP BY n_regionkey")
sql("nested_lateral_table", "region", "SELECT r_regionkey, t.i FROM region, LATERAL (SELECT explode(sequence(0, r_regionkey)) AS i) t", "SELECT r_regionkey, unnest(range(0, r_regionkey + 1))::INTEGER AS i FROM region")


@query("udtf_split", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS word FROM nation")
def udtf_split(spark, sf):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for word in text.split("_"):
                yield (word,)

    spark.udtf.register("tidemill_words", Words)
    register(spark, sf, ["nation"])
    return spark.sql("SELECT n_nationkey, w.word FROM nation, LATERAL tidemill_words(n_name) w")


@query("udf_scalar", "SELECT n_nationkey, length(n_name)::BIGINT * 2 + n_nationkey AS score FROM nation")
def udf_scalar(spark, sf):
    @F.pandas_udf("long")
    def score(name: pd.Series, key: pd.Series) -> pd.Series:
        return name.str.len() * 2 + key

    return table(spark, sf, "nation").select("n_nationkey", score("n_name", "n_nationkey").alias("score"))


@query("udf_sql_function", "SELECT s_suppkey, round(s_acctbal * 1.1 + 5, 4) AS v FROM supplier")
def udf_sql_function(spark, sf):
    register(spark, sf, ["supplier"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemill_raise(x DOUBLE) RETURNS DOUBLE RETURN x * 1.1 + 5")
    return spark.sql("SELECT s_suppkey, round(tidemill_raise(s_acctbal), 4) AS v FROM supplier")


@query("udaf_grouped", "SELECT l_returnflag, round(sum(l_quantity * l_tax) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY l_returnflag")
def udaf_grouped(spark, sf):
    """A weighted mean as sums, so that it keeps partial aggregation."""
    w = F.sum(F.col("l_quantity") * F.col("l_tax")) / F.sum("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(w, 6).alias("weighted"))
