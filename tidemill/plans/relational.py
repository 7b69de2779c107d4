"""Queries for scans, projections, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import aggregates as A
from tidemill.operators import aggregates, joins, rows, scan, windows
from tidemill.plans.registry import query
from tidemill.session import table


def _sum(x, digits: int = 2):
    return F.round(F.sum(x), digits)


# --- scans and plumbing -----------------------------------------------------------


@query("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    keep = (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)
    return scan.prune(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], keep)


@query("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, CASE WHEN l_quantity > 30 THEN 'big' ELSE 'small' END AS size FROM lineitem")
def project_expr(spark, sf):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", price.alias("charge"), F.when(F.col("l_quantity") > 30, "big").otherwise("small").alias("size"))


@query("scan_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def scan_lookup(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return scan.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), rich, "o_custkey").select("o_orderkey", "o_totalprice")


@query("scan_sorted_merge", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def scan_sorted_merge(spark, sf):
    return rows.top_n(scan.sorted_scan(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), 25, F.desc("o_totalprice"), "o_orderkey")


@query("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(id, name)")
def values_rows(spark, sf):
    return scan.values(spark, [(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("empty_relation", "SELECT r_regionkey, r_name FROM region LIMIT 0")
def empty_relation(spark, sf):
    return scan.empty(table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("generator_cartesian", "SELECT a, b FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest(['x', 'y']) AS b)")
def generator_cartesian(spark, sf):
    return scan.cartesian(scan.list_rows(spark, "a", [1, 2, 3]), scan.list_rows(spark, "b", ["x", "y"]))


@query("sample_bernoulli")
def sample_bernoulli(spark, sf):
    return scan.sample(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 0.1, 7)


@query("expand_rows", "SELECT l_returnflag AS a, NULL::VARCHAR AS b, 1 AS gid FROM lineitem UNION ALL SELECT NULL, l_linestatus, 2 FROM lineitem")
def expand_rows(spark, sf):
    null = F.lit(None).cast("string")
    lists = [[F.col("l_returnflag"), null, F.lit(1)], [null, F.col("l_linestatus"), F.lit(2)]]
    return aggregates.expand(table(spark, sf, "lineitem"), lists, ["a", "b", "gid"])


@query("cache_replay", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.n, count(*) AS customers, (SELECT max(n) FROM c) AS most FROM c a GROUP BY a.n")
def cache_replay(spark, sf):
    per = rows.cached(table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))
    return per.groupBy("n").agg(F.count("*").alias("customers")).crossJoin(F.broadcast(per.agg(F.max("n").alias("most"))))


# --- joins ------------------------------------------------------------------------

_CUST_ORDERS = "SELECT c_custkey, o_orderkey, o_totalprice FROM customer {} JOIN orders ON c_custkey = o_custkey {}"


def _pair(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _customers_orders(how: str, strategy: str = "auto", residual: bool = True):
    def build(spark, sf):
        c, o = _pair(spark, sf)
        extra = (c["c_acctbal"] < o["o_totalprice"] / 20) if residual else None
        return joins.join(c, o, [("c_custkey", "o_custkey")], how, extra, strategy).select("c_custkey", "o_orderkey", "o_totalprice")

    return build


for _name, _how, _sql in (("join_inner", "inner", ""), ("join_left", "left", "LEFT"), ("join_right", "right", "RIGHT"), ("join_full", "full", "FULL")):
    query(_name, _CUST_ORDERS.format(_sql, "AND c_acctbal < o_totalprice / 20"))(_customers_orders(_how))
for _strategy in ("broadcast", "merge", "hash", "bka"):
    query(f"hint_{_strategy}", _CUST_ORDERS.format("", ""))(_customers_orders("inner", _strategy, residual=False))
query("join_hash_outer_build_left", _CUST_ORDERS.format("LEFT", ""))(_customers_orders("left", "hash", residual=False))


@query("hint_nested_loop", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def hint_nested_loop(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return joins.join(n, r, [("n_regionkey", "r_regionkey")], strategy="nested_loop").select("n_name", "r_name")


@query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    return table(spark, sf, "nation").select("n_name").crossJoin(joins.small(table(spark, sf, "region").select("r_name")))


@query("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > n_nationkey * 300")
def join_theta(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").select("n_nationkey")
    return joins.theta(s, n, (s["s_nationkey"] < n["n_nationkey"]) & (s["s_acctbal"] > n["n_nationkey"] * 300)).select("s_suppkey", "n_nationkey")


@query("join_range_buckets", "SELECT p_partkey, lo FROM part JOIN (SELECT unnest(range(900, 2100, 150))::DOUBLE AS lo) ON p_retailprice >= lo AND p_retailprice < lo + 150")
def join_range_buckets(spark, sf):
    spans = spark.range(900, 2100, 150).select(F.col("id").cast("double").alias("lo"), (F.col("id") + 150).cast("double").alias("hi"))
    return joins.ranges(table(spark, sf, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, sf):
    c, o = _pair(spark, sf)
    return joins.semi(c, o.filter("o_totalprice > 300000"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("join_semi_merge", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi_merge(spark, sf):
    c, o = _pair(spark, sf)
    return joins.semi(c, o.filter("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "merge").select("c_custkey")


@query("join_semi_theta", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > s_nationkey AND n_regionkey = 1)")
def join_semi_theta(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").filter("n_regionkey = 1").select("n_nationkey")
    return joins.theta(s, n, n["n_nationkey"] > s["s_nationkey"], "left_semi").select("s_suppkey")


@query("join_semi_materialized", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_semi_materialized(spark, sf):
    keys = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")).distinct()
    return table(spark, sf, "orders").join(joins.small(keys), "o_custkey", "left_semi").select("o_orderkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark, sf):
    c, o = _pair(spark, sf)
    return joins.anti(c, o.filter("o_totalprice > 200000"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("join_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def join_not_in(spark, sf):
    c, o = _pair(spark, sf)
    return joins.not_in(c, o.filter("o_totalprice > 250000"), "c_custkey", "o_custkey").select("c_custkey")


@query("join_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END FROM orders)")
def join_not_in_null(spark, sf):
    c, o = _pair(spark, sf)
    return joins.not_in(c, o.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("o_custkey")), "c_custkey", "o_custkey").select("c_custkey")


@query("join_group", "SELECT c_custkey, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_group(spark, sf):
    c, o = _pair(spark, sf)
    return joins.group_join(c, o, [("c_custkey", "o_custkey")], [F.count("o_orderkey").alias("n"), _sum("o_totalprice").alias("total")])


@query("join_scalar_left", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def join_scalar_left(spark, sf):
    c, o = _pair(spark, sf)
    top = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return joins.join(c, top, [("c_custkey", "o_custkey")], "left").select("c_custkey", "top")


@query("join_index_lookup", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def join_index_lookup(spark, sf):
    index = table(spark, sf, "orders").filter(F.col("o_custkey").between(10, 40)).select(F.col("o_orderkey").alias("pk"))
    primary = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return joins.join(primary, index, [("o_orderkey", "pk")]).select("o_orderkey", "o_orderpriority")


@query("join_multi", "SELECT n_name, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_brand")
def join_multi(spark, sf):
    l, p, s, n = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))
    j = l.join(p, l["l_partkey"] == p["p_partkey"]).join(s, l["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"))


@query("join_salted", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem JOIN (SELECT 'A' AS f UNION ALL SELECT 'N' UNION ALL SELECT 'N') ON l_returnflag = f GROUP BY 1, 2")
def join_salted(spark, sf):
    flags = scan.values(spark, [("A",), ("N",), ("N",)], "f string")
    return joins.salted(table(spark, sf, "lineitem"), flags, "l_returnflag", "f").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "join_as_of",
    "SELECT e.event_id, p.value AS last_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def join_as_of(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return joins.as_of(events.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "last_value").select("event_id", "last_value")


# --- aggregates -------------------------------------------------------------------


@query(
    "agg_hash",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS low, max(l_tax) AS high, count(*) AS n FROM lineitem GROUP BY ALL",
)
def agg_hash(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        _sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("low"), F.max("l_tax").alias("high"), F.count("*").alias("n")
    )


@query("agg_sorted", "SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_suppkey")
def agg_sorted(spark, sf):
    return aggregates.sorted_aggregate(table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate"), ["l_suppkey"], F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"))


@query("agg_two_phase", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def agg_two_phase(spark, sf):
    return aggregates.two_phase(
        table(spark, sf, "orders").select("o_orderstatus", "o_totalprice"), ["o_orderstatus"],
        [F.count("*").alias("n"), F.sum("o_totalprice").alias("t")], [F.sum("n").alias("n"), _sum("t").alias("total")],
    )


@query("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total, coalesce(sum(o_totalprice), 0) AS total0 FROM orders WHERE o_orderkey < 0")
def agg_global_empty(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey < 0").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), A.sum0(F.col("o_totalprice")).alias("total0"))


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("lines")
    )


@query(
    "agg_multi_distinct",
    "SELECT o_orderpriority, count(DISTINCT (a, b)) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS pairs FROM (SELECT o_orderpriority, nullif(o_orderstatus, 'P') AS a, o_custkey AS b FROM orders) GROUP BY o_orderpriority",
)
def agg_multi_distinct(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.col("o_custkey").alias("b"))
    return o.groupBy("o_orderpriority").agg(F.count_distinct("a", "b").alias("pairs"))


@query("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_tax) FILTER (WHERE l_discount = 0.1), 4) AS tax FROM lineitem GROUP BY l_linestatus")
def agg_filter(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_tax) FILTER (WHERE l_discount = 0.1), 4) AS tax FROM lineitem GROUP BY l_linestatus")


_GROUPING = "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, (grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber))::BIGINT AS gid FROM lineitem GROUP BY {}"
_KEYS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("agg_rollup", _GROUPING.format("ROLLUP (l_returnflag, l_linestatus, l_linenumber)"))
def agg_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup(*_KEYS).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("agg_cube", _GROUPING.format("CUBE (l_returnflag, l_linestatus, l_linenumber)"))
def agg_cube(spark, sf):
    return table(spark, sf, "lineitem").cube(*_KEYS).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("agg_grouping_sets", _GROUPING.format("GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())"))
def agg_grouping_sets(spark, sf):
    return aggregates.grouping_sets(table(spark, sf, "lineitem"), [_KEYS[:2], _KEYS[2:], []], _KEYS, F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("agg_grouping_flags", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::BIGINT AS g1, grouping(l_linestatus)::BIGINT AS g2, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_grouping_flags(spark, sf):
    return table(spark, sf, "lineitem").rollup(*_KEYS[:2]).agg(F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.count("*").alias("n"))


@query(
    "agg_group_id",
    "SELECT l_returnflag, 0::BIGINT AS group_id, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 1, count(*) FROM lineitem GROUP BY l_returnflag",
)
def agg_group_id(spark, sf):
    """GROUP_ID numbers repeated grouping sets."""
    once = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return once.select("l_returnflag", F.explode(F.expr("array(0L, 1L)")).alias("group_id"), "n")


_U = "CASE WHEN {0} >= 0 THEN {0}::DECIMAL(20,0) ELSE ({0}::HUGEINT + 18446744073709551616::HUGEINT)::DECIMAL(20,0) END"


@query(
    "agg_bit",
    "SELECT l_returnflag, bit_and(l_orderkey)::DECIMAL(20,0) AS a, bit_or(l_orderkey)::DECIMAL(20,0) AS o, bit_xor(l_orderkey)::DECIMAL(20,0) AS x FROM lineitem GROUP BY l_returnflag",
)
def agg_bit(spark, sf):
    k = F.col("l_orderkey")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.bit_and_agg(k).alias("a"), A.bit_or_agg(k).alias("o"), A.bit_xor_agg(k).alias("x"))


@query("agg_bit_empty", "SELECT 18446744073709551615::DECIMAL(20,0) AS a, 0::DECIMAL(20,0) AS o, 0::DECIMAL(20,0) AS x")
def agg_bit_empty(spark, sf):
    k = F.col("l_orderkey")
    return table(spark, sf, "lineitem").filter("l_orderkey < 0").agg(A.bit_and_agg(k).alias("a"), A.bit_or_agg(k).alias("o"), A.bit_xor_agg(k).alias("x"))


@query(
    "agg_stddev_var",
    "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(regr_sxx(l_tax, l_discount), 4) AS sxx, round(regr_syy(l_tax, l_discount), 4) AS syy FROM lineitem GROUP BY l_returnflag",
)
def agg_stddev_var(spark, sf):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    r = F.round
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        r(A.std(q), 6).alias("sp"), r(F.stddev_samp(q), 6).alias("ss"), r(A.variance(q), 6).alias("vp"), r(F.var_samp(q), 6).alias("vs"),
        r(F.covar_pop(q, t), 6).alias("cp"), r(F.covar_samp(q, t), 6).alias("cs"), r(A.regr_sxx(t, d), 4).alias("sxx"), r(A.regr_syy(t, d), 4).alias("syy"),
    )


@query("agg_sum_avg_exact", "SELECT l_returnflag, sum(l_orderkey)::DECIMAL(38,0) AS s, round(avg(l_linenumber), 4) AS a FROM lineitem GROUP BY l_returnflag")
def agg_sum_avg_exact(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.sum_exact(F.col("l_orderkey")).alias("s"), A.avg(F.col("l_linenumber")).cast("double").alias("a"))


@query(
    "agg_group_concat",
    "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS letters FROM nation GROUP BY n_regionkey",
)
def agg_group_concat(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(A.group_concat(n, "|").alias("names"), A.group_concat(F.left(n, F.lit(1)), distinct=True).alias("letters"))


@query(
    "agg_json",
    "SELECT n_regionkey, '[' || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE n_nationkey::VARCHAR END, ',' ORDER BY n_nationkey) || ']' AS arr, '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' ORDER BY n_nationkey) || '}' AS obj FROM nation GROUP BY n_regionkey",
)
def agg_json(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(A.json_arrayagg(F.when(k % 2 != 0, k), k).alias("arr"), A.json_objectagg(k, F.col("n_name"), k).alias("obj"))


@query(
    "agg_json_typed",
    "SELECT n_regionkey, '{' || string_agg('\"' || k || '\":' || v, ',' ORDER BY v) || '}' AS obj, string_agg(k, ',' ORDER BY v) AS names FROM (SELECT n_regionkey, left(n_name, 1) AS k, max(n_nationkey) AS v FROM nation GROUP BY ALL) GROUP BY n_regionkey",
)
def agg_json_typed(spark, sf):
    """Numbers stay numbers, the last of equal keys wins; distinct texts in the order of another column."""
    k, v = F.left("n_name", F.lit(1)), F.col("n_nationkey")
    last = table(spark, sf, "nation").groupBy("n_regionkey", k.alias("k")).agg(F.max("n_nationkey").alias("m"))
    names = last.groupBy("n_regionkey").agg(A.group_concat(F.col("k"), distinct=True, order=F.col("m")).alias("names"))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(A.json_objectagg(k, v, v).alias("obj")).join(names, "n_regionkey")


@query("agg_json_global", "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total, 25 AS members FROM nation")
def agg_json_global(spark, sf):
    """Partial JSON aggregates by region, merged."""
    k = F.col("n_nationkey")
    part = table(spark, sf, "nation").groupBy("n_regionkey").agg(A.json_arrayagg(k, k).alias("a"), A.json_objectagg(F.col("n_name"), k, k).alias("o"))
    whole = part.agg(A.json_array_globalagg(F.col("a")).alias("a"), A.json_object_globalagg(F.col("o")).alias("o"))
    values = F.from_json("a", "array<bigint>")
    return whole.select(F.size(values).cast("long").alias("n"), F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y).alias("total"), F.size(F.json_object_keys("o")).alias("members"))


@query("agg_hll_exact_bound", "SELECT l_returnflag, TRUE AS near FROM lineitem GROUP BY l_returnflag")
def agg_hll_exact_bound(spark, sf):
    """Sketched distinct counts lie within five per cent of the exact ones.

    They are counted apart: beside a distinct count, each pair of flag and part would hold a sketch of its own.
    """
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey")
    sketched = lines.groupBy("l_returnflag").agg(A.hyperloglog(F.col("l_partkey")).alias("sketch"))
    exact = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.countDistinct("l_partkey").alias("exact"))
    got = sketched.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return got.select("l_returnflag", (F.abs(F.col("sketch") - F.col("exact")) <= F.col("exact") * 0.05).alias("near"))


@query("agg_hll_merge", "SELECT TRUE AS near")
def agg_hll_merge(spark, sf):
    """Partial sketches by shard, merged: within five per cent of the exact count."""
    lines = table(spark, sf, "lineitem")
    parts = lines.groupBy("l_suppkey").agg(A.hll_partial(F.col("l_partkey")).alias("s"))
    exact = lines.agg(F.countDistinct("l_partkey").alias("exact"))
    return parts.agg(A.hll_final(F.col("s")).alias("n")).crossJoin(F.broadcast(exact)).select((F.abs(F.col("n") - F.col("exact")) <= F.col("exact") * 0.05).alias("near"))


@query("agg_checksum_merge", "SELECT TRUE AS same, TRUE AS unordered")
def agg_checksum_merge(spark, sf):
    """Partial checksums merge to the whole one; the order of rows does not matter."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cols = [F.col(c) for c in o.columns]
    whole = o.agg(A.checksum(*cols).alias("w"), A.hashcheck(*cols).alias("h"))
    merged = o.groupBy("o_orderstatus").agg(A.checksum(*cols).alias("p")).agg(A.checksum_merge(F.col("p")).alias("m"))
    again = o.orderBy(F.desc("o_orderkey")).agg(A.hashcheck(*cols).alias("h2"))
    return whole.crossJoin(merged).crossJoin(again).select((F.col("w") == F.col("m")).alias("same"), (F.col("h") == F.col("h2")).alias("unordered"))


@query("agg_first_dependent", "SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def agg_first_dependent(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").select("o_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy("c_custkey").agg(A.any_row(F.col("c_name")).alias("c_name"), F.count("*").alias("n"))


@query("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def agg_distinct_rows(spark, sf):
    return aggregates.distinct_rows(table(spark, sf, "lineitem"), *_KEYS)


@query("agg_single_value", "SELECT o_orderkey, any_value(o_custkey) AS only FROM orders GROUP BY o_orderkey")
def agg_single_value(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderkey").agg(A.single_value(F.col("o_custkey")).alias("only"))


# --- windows ----------------------------------------------------------------------

_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


_ORDER = ["o_totalprice", "o_orderkey"]


@query(
    "win_rank",
    f"SELECT o_orderkey, row_number() {_W} AS row_number, rank() {_W} AS rank, dense_rank() {_W} AS dense_rank, round(percent_rank() {_W}, 6) AS percent_rank, round(cume_dist() {_W}, 6) AS cume_dist, ntile(4) {_W} AS ntile FROM orders",
)
def win_rank(spark, sf):
    made = windows.ranking(["o_custkey"], _ORDER)
    return _orders(spark, sf).select("o_orderkey", *[(F.round(c, 6) if n in {"percent_rank", "cume_dist"} else c).alias(n) for n, c in made.items()])


@query("win_rank_ties", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS d FROM lineitem")
def win_rank_ties(spark, sf):
    made = windows.ranking(["l_suppkey"], ["l_quantity"])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", made["rank"].alias("r"), made["dense_rank"].alias("d"))


@query(
    "win_lag_lead",
    f"SELECT o_orderkey, lag(o_totalprice) {_W} AS a, lag(o_totalprice, 2, 0) {_W} AS b, lead(o_orderkey, 1, -1) {_W} AS c FROM orders",
)
def win_lag_lead(spark, sf):
    w = windows.over(["o_custkey"], _ORDER)
    return _orders(spark, sf).select("o_orderkey", F.lag("o_totalprice").over(w).alias("a"), F.lag("o_totalprice", 2, 0.0).over(w).alias("b"), F.lead("o_orderkey", 1, -1).over(w).alias("c"))


@query(
    "win_first_last_nth",
    "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)",
)
def win_first_last_nth(spark, sf):
    w = windows.rows(["o_custkey"], _ORDER, -1, 2)
    k = "o_orderkey"
    return _orders(spark, sf).select(k, F.first(k).over(w).alias("f"), F.last(k).over(w).alias("l"), F.nth_value(k, 2).over(w).alias("n"))


_FRAMES = {
    "win_rows_sliding": ("ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING", -2, 1),
    "win_rows_preceding": ("ROWS 2 PRECEDING", -2, 0),
    "win_unbounded_preceding": ("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", windows.FIRST, 0),
    "win_unbounded_following": ("ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING", -1, windows.LAST),
    "win_unbounded_both": ("ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", windows.FIRST, windows.LAST),
}
for _name, (_frame, _low, _high) in _FRAMES.items():

    def _framed(spark, sf, low=_low, high=_high):
        w = windows.rows(["o_custkey"], _ORDER, low, high)
        return _orders(spark, sf).select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"), F.count("*").over(w).alias("n"), F.min("o_orderkey").over(w).alias("low"))

    query(
        _name,
        f"SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, min(o_orderkey) OVER w AS low FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey {_frame})",
    )(_framed)


@query("win_range", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM lineitem")
def win_range(spark, sf):
    w = windows.span(["l_suppkey"], ["l_quantity"], -2, 3)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"))


@query("win_hash", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS a, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def win_hash(spark, sf):
    over = lambda c: windows.hash_window(c, ["o_custkey"])
    return _orders(spark, sf).select("o_orderkey", F.round(over(F.avg("o_totalprice")), 4).alias("a"), over(F.count("*")).alias("n"), over(F.max("o_totalprice")).alias("top"))


@query("win_named", "SELECT n_name, sum(n_nationkey) OVER w::BIGINT AS s, row_number() OVER w AS r FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)")
def win_named(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_name, sum(n_nationkey) OVER w AS s, CAST(row_number() OVER w AS BIGINT) AS r FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)")


@query("win_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def win_top_per_group(spark, sf):
    return rows.top_n_per_group(_orders(spark, sf), 2, ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


# --- sort, limit, set operations ---------------------------------------------------


@query("sort_full", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_full(spark, sf):
    return rows.sort(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), "c_custkey")


@query("sort_topn", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def sort_topn(spark, sf):
    return rows.top_n(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 20, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 40")
def limit_offset(spark, sf):
    return rows.top_n(table(spark, sf, "orders").select("o_orderkey"), 15, "o_orderkey", offset=40)


@query("sort_nulls", "SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS v FROM (SELECT n_nationkey AS k FROM nation) ORDER BY v NULLS FIRST, k LIMIT 12")
def sort_nulls(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).withColumn("v", F.when(F.col("k") % 3 != 0, F.col("k")))
    return rows.top_n(n, 12, rows.nulls_low("v"), "k")


_A = "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity < 5"
_B = "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0"


def _two(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return table(spark, sf, "lineitem").filter("l_quantity < 5").select(F.col("l_suppkey").alias("k")), s.filter("k % 2 = 0").union(s.filter("k % 4 = 0"))


for _name, _sql, _build in (
    ("union_all", "UNION ALL", rows.union_all),
    ("union_distinct", "UNION", rows.union),
    ("intersect", "INTERSECT", rows.intersect),
    ("intersect_all", "INTERSECT ALL", lambda a, b: rows.intersect(a, b, True)),
    ("except", "EXCEPT", rows.except_),
    ("except_all", "EXCEPT ALL", lambda a, b: rows.except_(a, b, True)),
):
    query(_name, f"({_A}) {_sql} ({_B})")(lambda spark, sf, build=_build: build(*_two(spark, sf)))


@query("union_coerced", "SELECT n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier")
def union_coerced(spark, sf):
    return rows.union_all(table(spark, sf, "nation").select(F.col("n_nationkey").alias("v")), table(spark, sf, "supplier").select("s_acctbal"))


@query("union_limit", "SELECT count(*) AS n FROM (SELECT * FROM ((SELECT n_nationkey FROM nation) UNION ALL (SELECT r_regionkey FROM region)) LIMIT 7)")
def union_limit(spark, sf):
    both = rows.union_all(table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "region").select("r_regionkey"))
    return rows.limit(both, 7).agg(F.count("*").alias("n"))
