"""Queries for data changes, column types, sequences, session functions and runtime filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import session as X
from tidemill.functions import types as Y
from tidemill.operators import exchange, modify
from tidemill.plans.registry import query
from tidemill.session import table

C = F.col


@query("modify_update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_acctbal < 0 THEN 'reset' ELSE s_name END AS s_name FROM supplier")
def modify_update(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_name")
    return modify.update(s, C("s_acctbal") < 0, s_acctbal=F.lit(0.0), s_name=F.lit("reset"))


@query("modify_delete", "SELECT s_suppkey FROM supplier WHERE NOT coalesce(nullif(s_nationkey, 3) > 10, FALSE)")
def modify_delete(spark, sf):
    return modify.delete(table(spark, sf, "supplier"), F.nullif("s_nationkey", F.lit(3)) > 10).select("s_suppkey")


@query("modify_replace", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, 'new' FROM nation WHERE n_nationkey % 2 = 0")
def modify_replace(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    even = n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit("new").alias("n_name"))
    return modify.replace(n, even.union(even.select((C("n_nationkey") + 100).alias("n_nationkey"), "n_name")), ["n_nationkey"])


@query("modify_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 99, 7")
def modify_upsert(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    rows = n.filter("n_nationkey < 5").select("n_nationkey", F.lit(10).alias("n_regionkey")).union(spark.createDataFrame([(99, 7)], "n_nationkey int, n_regionkey int"))
    return modify.upsert(n, rows, ["n_nationkey"], n_regionkey=C("n_regionkey") + C("new_n_regionkey"))


@query("modify_replace_repeated", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'last' ELSE n_name END AS n_name FROM nation")
def modify_replace_repeated(spark, sf):
    """Of new rows with one key the last stays."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = spark.createDataFrame([(3, "first", 1), (3, "last", 2), (3, "early", 0)], "n_nationkey int, n_name string, at int")
    return modify.replace(n.withColumn("at", F.lit(0)), rows, ["n_nationkey"], "at").select("n_nationkey", "n_name")


@query("sequence_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 999 AS id FROM orders")
def sequence_numbers(spark, sf):
    return modify.numbered(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "id", "o_totalprice", "o_orderkey", start=1000).select("o_orderkey", "id")


_PRIORITY = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "types_enum_set",
    "SELECT o_orderkey, coalesce(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority), 0)::BIGINT AS ord, ['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'][o_orderkey % 6] AS mem, list_filter(['a', 'b', 'c'], lambda x, i: (o_orderkey >> (i - 1)) & 1 = 1) AS st, (CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 2 END)::BIGINT AS bits FROM orders",
)
def types_enum_set(spark, sf):
    text = F.when(C("o_orderkey") % 2 == 0, "c,a").otherwise("b,x")
    return table(spark, sf, "orders").select(
        "o_orderkey", Y.enum_order(C("o_orderpriority"), _PRIORITY).alias("ord"), Y.enum_member(C("o_orderkey") % 6, _PRIORITY).alias("mem"),
        Y.set_members(C("o_orderkey"), ["a", "b", "c"]).alias("st"), Y.set_bits(text, ["a", "b", "c"]).alias("bits"),
    )


@query("types_collation_group", "SELECT lower(k) AS k, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS k FROM customer) GROUP BY lower(k)")
def types_collation_group(spark, sf):
    k = F.when(C("c_custkey") % 2 == 0, C("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    grouped = table(spark, sf, "customer").select(Y.case_insensitive(k).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return grouped.select(F.lower(C("k")).cast("string").alias("k"), "n")


@query("types_mediumint", "SELECT n_nationkey * 1000 AS m FROM nation")
def types_mediumint(spark, sf):
    return table(spark, sf, "nation").select(Y.mediumint(C("n_nationkey") * 1000).alias("m"))


@query("fn_session")
def fn_session(spark, sf):
    return spark.range(1).select(
        X.version().alias("version"), X.current_user().alias("user"), X.database().alias("db"), X.current_time_zone().alias("tz"), X.rand(7).alias("rand"), X.uuid().alias("uuid"),
        F.octet_length(X.random_bytes(4)).alias("bytes"), X.charset(F.lit("a")).alias("charset"), X.collation(F.lit("a")).alias("collation"), X.benchmark(3, F.lit(1)).alias("bench"),
    )


@query("join_runtime_filter", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 350000")
def join_runtime_filter(spark, sf):
    """A bloom filter of the filtered side's keys prunes the other side before its shuffle."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    spark.conf.set(name, "1MB")
    l, o = table(spark, sf, "lineitem").select("l_orderkey"), table(spark, sf, "orders").filter("o_totalprice > 350000").select("o_orderkey")
    return l.join(o.hint("merge"), l["l_orderkey"] == o["o_orderkey"]).agg(F.count("*").alias("n"))


@query("exchange_modes", "SELECT m AS mode, n, total FROM (SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders), (SELECT unnest(['DIRECT', 'PARTITION', 'RANDOM', 'RANGE', 'SINGLE']) AS m)")
def exchange_modes(spark, sf):
    """Every distribution keeps all rows."""
    o = table(spark, sf, "orders").select("o_orderkey")
    made = None
    for mode in ("DIRECT", "PARTITION", "RANDOM", "RANGE", "SINGLE"):
        keys = ["o_orderkey"] if mode in {"PARTITION", "RANGE"} else []
        part = exchange.exchange(o, mode, *keys).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total")).select(F.lit(mode).alias("mode"), "n", "total")
        made = part if made is None else made.unionByName(part)
    return made


@query("exchange_udf_hash", "SELECT count(*) AS n, TRUE AS inside FROM customer")
def exchange_udf_hash(spark, sf):
    """A function of the columns as the partition key."""
    from tidemill.sources.files import partition_id

    p = partition_id("UDF_HASH", [F.lower(F.col("c_name"))], 8)
    return table(spark, sf, "customer").select(p.alias("p")).agg(F.count("*").alias("n"), ((F.min("p") >= 0) & (F.max("p") < 8)).alias("inside"))
