"""Queries for files, snapshots, partitioning, streaming and the SQL dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill import dialect
from tidemill.plans.registry import query
from tidemill.session import register, table
from tidemill.sources import files
from tidemill.streaming import events as streams

C = F.col


@query("source_orc_round_trip", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def source_orc_round_trip(spark, sf) -> DataFrame:
    path = files.scratch(spark, "orc")
    files.write_columnar(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "o_orderstatus")
    return files.read_columnar(spark, path).filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    "source_orc_full_types",
    "SELECT n_nationkey AS i, n_nationkey::SMALLINT AS sm, n_nationkey::TINYINT AS ti, (n_nationkey / 4.0)::DOUBLE AS d, (n_nationkey / 8.0)::DECIMAL(20,2) AS de, (1970 + n_nationkey)::SMALLINT AS y, TIMESTAMP '2020-01-01' + n_nationkey * INTERVAL 1 DAY AS ts, DATE '2020-01-01' + n_nationkey AS dt, '{\"k\": ' || n_nationkey || '}' AS js, n_name::BLOB AS bl FROM nation",
)
def source_orc_full_types(spark, sf):
    k = C("n_nationkey")
    start = F.lit("2020-01-01")
    made = table(spark, sf, "nation").select(
        k.alias("i"), k.cast("smallint").alias("sm"), k.cast("tinyint").alias("ti"), (k / 4).alias("d"), F.round(k.cast("decimal(20,4)") / 8, 2).cast("decimal(20,2)").alias("de"), (k + 1970).cast("smallint").alias("y"),
        (start.cast("timestamp_ntz") + F.make_dt_interval(k)).alias("ts"), F.date_add(start.cast("date"), k).alias("dt"), F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}")).alias("js"), C("n_name").cast("binary").alias("bl"),
    )
    path = files.scratch(spark, "types")
    files.write_columnar(made, path)
    return files.read_columnar(spark, path).select(*made.columns)


@query("source_outfile_round_trip", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 0 THEN n_name || chr(9) || '\"x' END AS odd FROM nation")
def source_outfile_round_trip(spark, sf):
    odd = F.when(C("n_regionkey") != 0, F.concat("n_name", F.lit('\t"x')))
    path = files.scratch(spark, "outfile")
    files.into_outfile(table(spark, sf, "nation").select("n_nationkey", "n_name", odd.alias("odd")), path)
    return files.read_delimited(spark, path, "n_nationkey int, n_name string, odd string")


@query("source_insert_select", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def source_insert_select(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    path = files.scratch(spark, "insert")
    joined = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_nationkey")
    joined.filter("n_nationkey < 10").write.parquet(path)
    joined.filter("n_nationkey >= 10").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("r_name").agg(F.count("*").alias("n"))


@query(
    "snapshot_merge_on_read",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 7",
)
def snapshot_merge_on_read(spark, sf):
    """Base rows, later images of some and deletes of others."""
    base = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    changed = base.filter("o_orderkey % 10 = 3").select("o_orderkey", (C("o_totalprice") + 1).alias("o_totalprice"), F.lit(5).cast("long").alias("version"))
    removed = base.filter("o_orderkey % 10 IN (3, 7)").select("o_orderkey", F.lit(4).cast("long").alias("version"))
    return files.merge_on_read(base, changed, removed, ["o_orderkey"])


@query(
    "snapshot_as_of",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 5 <> 1",
)
def snapshot_as_of(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    row = lambda df, name, version, gone: df.select("n_nationkey", name.alias("n_name"), F.lit(version).alias("version"), F.lit(gone).alias("deleted"))
    versions = row(n, C("n_name"), 1, False).union(row(n.filter("n_nationkey % 3 = 0"), F.lit("new"), 2, False)).union(row(n.filter("n_nationkey % 5 = 1"), C("n_name"), 3, True)).union(row(n, F.lit("later"), 9, False))
    return files.as_of(versions, 5, ["n_nationkey"])


@query(
    "partition_strategies",
    "SELECT o_orderkey, (o_orderkey % 8)::BIGINT AS direct, (CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 ELSE 2 END)::BIGINT AS ranged, (CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 WHEN o_orderstatus = 'P' THEN 1 END)::BIGINT AS listed FROM orders",
)
def partition_strategies(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", files.partition_id("DIRECT_HASH", ["o_orderkey"], 8).alias("direct"), files.partition_id("RANGE", ["o_totalprice"], 3, [50000.0, 150000.0]).alias("ranged"),
        files.partition_id("LIST", ["o_orderstatus"], 2, [["F", "O"], ["P"]]).alias("listed"),
    )


@query("partition_hash_complete", "SELECT count(*) AS n, TRUE AS inside FROM orders")
def partition_hash_complete(spark, sf):
    p = files.partition_id("KEY", ["o_orderkey", "o_custkey"], 16)
    return table(spark, sf, "orders").select(p.alias("p")).agg(F.count("*").alias("n"), (F.min("p") >= 0).alias("a"), (F.max("p") < 16).alias("b")).select("n", (C("a") & C("b")).alias("inside"))


@query("information_schema_tables", "SELECT 'nation' AS table_name, TRUE AS temporary UNION ALL SELECT 'region', TRUE")
def information_schema_tables(spark, sf):
    register(spark, sf, ["nation", "region"])
    return files.tables(spark).filter("table_name IN ('nation', 'region')").select("table_name", "temporary")


# --- streaming: each stream is drained over the table's file ---------------------------------


def _events(spark, sf):
    like = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.select(*like.columns).withColumn("ts", C("ts").cast("timestamp"))


def _local(df):
    return df.select(*[C(c).cast("timestamp_ntz").alias(c) if c in {"start", "end"} else C(c) for c in df.columns])


@query(
    "stream_tumbling",
    "SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') + INTERVAL 10 MINUTE AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL",
)
def stream_tumbling(spark, sf):
    made = streams.tumbling(_events(spark, sf), "10 minutes", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return _local(streams.drain(made))


@query(
    "stream_sliding",
    "SELECT s AS start, s + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL",
)
def stream_sliding(spark, sf):
    return _local(streams.drain(streams.sliding(_events(spark, sf), "1 hour", "30 minutes", "1 hour", F.count("*").alias("n"))))


@query(
    "stream_sessions",
    "SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s",
)
def stream_sessions(spark, sf):
    events = table(spark, sf, "events").select("ts", "user_id")
    return streams.sessions(events, "30 minutes", "1 hour", F.count("*").alias("n"))


@query("stream_foreach_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_foreach_batch(spark, sf):
    path = files.scratch(spark, "sink")
    streams.for_each_batch(_events(spark, sf), lambda df, epoch: df.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(path))
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("stream_append_dedup", "SELECT DISTINCT event_id FROM events WHERE event_type = 'purchase'")
def stream_append_dedup(spark, sf):
    stream = _events(spark, sf).filter("event_type = 'purchase'")
    return streams.drain(streams.deduplicated(stream, "1000 days", "event_id").select("event_id"), "append")


# --- the dialect -----------------------------------------------------------------------------


def mysql(name: str, tables: str, text: str, oracle: str) -> None:
    def build(spark, sf):
        register(spark, sf, tables.split())
        return dialect.run(spark, text)

    query(name, oracle)(build)


mysql(
    "dialect_operators", "nation",
    "SELECT n_nationkey, n_regionkey <=> NULL AS a, n_nationkey DIV 4 AS b, IFNULL(NULL, `n_name`) AS c, (n_nationkey > 3 || n_regionkey = 1) AS d, (n_nationkey > 3 && n_regionkey = 1) AS e, LENGTH(n_name) AS f, UCASE(n_name) AS g # comment\nFROM nation -- end",
    "SELECT n_nationkey, FALSE AS a, (n_nationkey // 4)::BIGINT AS b, n_name AS c, (n_nationkey > 3 OR n_regionkey = 1) AS d, (n_nationkey > 3 AND n_regionkey = 1) AS e, strlen(n_name)::INTEGER AS f, upper(n_name) AS g FROM nation",
)
mysql(
    "dialect_group_concat", "nation", 'SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name SEPARATOR "; ") AS names FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 1, 3',
    "SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 3 OFFSET 1",
)
mysql("dialect_json_paths", "events", "SELECT event_id, props->>'$.k' AS k, events.props->'$.k' AS j FROM events", "SELECT event_id, props ->> '$.k' AS k, (props -> '$.k')::VARCHAR AS j FROM events")
mysql(
    "dialect_hints", "customer orders", "SELECT /*+ HASH_JOIN(customer, orders) */ c_custkey, o_orderkey FROM customer STRAIGHT_JOIN orders ON c_custkey = o_custkey WHERE c_name REGEXP '7$'",
    "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE regexp_matches(c_name, '7$')",
)
mysql(
    "dialect_functions", "orders",
    "SET spark.tidemill.unused = 1; SELECT o_orderkey, TO_DAYS(o_orderdate) AS d, FROM_DAYS(TO_DAYS(o_orderdate)) AS f, STRCMP(o_orderstatus, 'O') AS s, TRUNCATE(o_totalprice, 1) AS t, BIT_NOT64(5) AS n FROM orders",
    "SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528)::BIGINT AS d, o_orderdate::DATE AS f, CASE WHEN o_orderstatus < 'O' THEN -1 WHEN o_orderstatus > 'O' THEN 1 ELSE 0 END AS s, (trunc(o_totalprice::DECIMAL(18,2) * 10) / 10)::DOUBLE AS t, 18446744073709551610::DECIMAL(20,0) AS n FROM orders",
)

mysql(
    "dialect_dates", "orders",
    "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS a, DATE_SUB(o_orderdate, INTERVAL o_custkey % 7 DAY) AS b, DATE_FORMAT(o_orderdate, '%Y/%m/%d %W') AS c, DATE_ADD(o_orderdate, INTERVAL '1 6' DAY_HOUR) AS d, STR_TO_DATE('03.02.2001', '%d.%m.%Y') AS e, MONTHNAME(o_orderdate) AS m FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - (o_custkey % 7) * INTERVAL 1 DAY AS b, strftime(o_orderdate, '%Y/%m/%d %A') AS c, o_orderdate + INTERVAL 30 HOUR AS d, TIMESTAMP '2001-02-03' AS e, monthname(o_orderdate) AS m FROM orders",
)
mysql(
    "dialect_values", "nation",
    "SELECT n_nationkey, ELT(n_regionkey, 'a', 'b') AS e, FIELD(n_regionkey, 3, 1) AS f, GREATEST(n_regionkey, NULLIF(n_nationkey, 3)) AS g, CAST(n_nationkey AS SIGNED) AS s, CAST(n_nationkey AS CHAR) AS c, CONVERT(n_name USING utf8mb4) AS u, MOD(n_nationkey, n_regionkey) AS m, SQRT(0 - n_nationkey - 1) AS q FROM nation",
    "SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS e, CASE n_regionkey WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS f, CASE WHEN n_nationkey <> 3 THEN greatest(n_regionkey, n_nationkey) END AS g, n_nationkey::BIGINT AS s, n_nationkey::VARCHAR AS c, n_name AS u, n_nationkey % nullif(n_regionkey, 0) AS m, NULL::DOUBLE AS q FROM nation",
)
mysql(
    "dialect_catalogue", "orders",
    "SELECT o_orderkey, WEEK(o_orderdate, 3) AS w, JSON_LENGTH('[1, 2]') AS l, JSON_TYPE('{}') AS t, JSON_DEPTH('[1, [2]]') AS d, JSON_MERGE_PATCH('{\"a\": 1}', '{\"a\": 2}') AS p, FORMAT(1234567.891, 2) AS f, SUBSTRING_INDEX(o_orderpriority, '-', 1) AS s, FIND_IN_SET(o_orderstatus, 'F,O,P') AS i, TO_SECONDS(o_orderdate) AS u, CRC32('x') AS c, MAKETIME(1, 2, 3) AS m, UNCOMPRESS(COMPRESS('ab')) = CAST('ab' AS BINARY) AS z FROM orders",
    "SELECT o_orderkey, weekofyear(o_orderdate)::INTEGER AS w, 2::BIGINT AS l, 'OBJECT' AS t, 3::BIGINT AS d, '{\"a\": 2}' AS p, '1,234,567.89' AS f, split_part(o_orderpriority, '-', 1) AS s, list_position(['F', 'O', 'P'], o_orderstatus)::BIGINT AS i, (epoch(o_orderdate) + 719528 * 86400::BIGINT)::BIGINT AS u, 2363233923::BIGINT AS c, '01:02:03' AS m, TRUE AS z FROM orders",
)
mysql(
    "dialect_user_variables", "nation",
    "SET @low = 3, @name = (SELECT max(n_name) FROM nation); SET @low = @low + 1; SELECT n_nationkey, @low AS low, @name AS top, @unset IS NULL AS u, 'a@low' AS s FROM nation WHERE n_nationkey > @low",
    "SELECT n_nationkey, 4 AS low, (SELECT max(n_name) FROM nation) AS top, TRUE AS u, 'a@low' AS s FROM nation WHERE n_nationkey > 4",
)
mysql("dialect_found_rows", "nation", "SELECT n_name FROM nation WHERE n_regionkey = 1; SELECT FOUND_ROWS() AS n, 'found_rows()' AS s", "SELECT count(*) AS n, 'found_rows()' AS s FROM nation WHERE n_regionkey = 1")
mysql(
    "dialect_transaction_clock", "orders",
    "SELECT o_orderkey, TIME_TO_TSO(o_orderdate, '+08:00') AS t, TSO_TO_TIME(TIME_TO_TSO(o_orderdate, '+08:00'), '+08:00') AS b, TSO_TO_TIME(TIME_TO_TSO('1970-01-01 08:00:01', '+08:00'), '+00:00') AS c, TIME_TO_TSO('no time', '+00:00') AS n FROM orders",
    "SELECT o_orderkey, ((epoch(date_trunc('second', o_orderdate))::BIGINT - 28800) * 1000 * 4194304)::BIGINT AS t, date_trunc('second', o_orderdate)::TIMESTAMP AS b, TIMESTAMP '1970-01-01 00:00:01' AS c, NULL::BIGINT AS n FROM orders",
)
mysql(
    "dialect_json_append", "nation",
    "SELECT n_nationkey, JSON_APPEND('{\"a\": [1], \"b\": {\"c\": 2}}', '$.a', CAST(n_nationkey AS CHAR)) AS a, JSON_APPEND('{\"a\": [1], \"b\": {\"c\": 2}}', '$.b.c', '3') AS b, JSON_APPEND('[1, [2]]', '$[1]', '3') AS c, JSON_APPEND('[1]', '$.x', '3') AS d FROM nation",
    "SELECT n_nationkey, '{\"a\": [1, ' || n_nationkey || '], \"b\": {\"c\": 2}}' AS a, '{\"a\": [1], \"b\": {\"c\": [2, 3]}}' AS b, '[1, [2, 3]]' AS c, '[1]' AS d FROM nation",
)
mysql("dialect_dual", "region", "SELECT 1 + 1 AS two, LENGTH('é') AS bytes FROM DUAL", "SELECT 2 AS two, 2 AS bytes")

mysql(
    "dialect_zero_division", "nation",
    "SELECT n_nationkey, n_nationkey / n_regionkey AS q, n_nationkey * 2 / 0 AS z, n_nationkey % n_regionkey AS m, n_nationkey DIV n_regionkey AS d, 9007199254740993 DIV 1 AS big FROM nation WHERE n_nationkey % 3 = 1",
    "SELECT n_nationkey, n_nationkey::DOUBLE / nullif(n_regionkey, 0) AS q, NULL::DOUBLE AS z, n_nationkey % nullif(n_regionkey, 0) AS m, (n_nationkey // nullif(n_regionkey, 0))::BIGINT AS d, 9007199254740993::BIGINT AS big FROM nation WHERE n_nationkey % 3 = 1",
)
mysql(
    "dialect_logic", "nation",
    "SELECT n_nationkey, n_nationkey || 0 AS o, n_nationkey && n_regionkey AS a, 2 XOR 1 AS x, n_nationkey = 1 XOR n_regionkey AS y, !n_regionkey AS n, IF(n_regionkey, 'yes', 'no') AS i, ~1 AS b, n_nationkey BETWEEN 3 AND 9 && n_regionkey > 1 AS w FROM nation",
    "SELECT n_nationkey, n_nationkey <> 0 AS o, n_nationkey <> 0 AND n_regionkey <> 0 AS a, FALSE AS x, (n_nationkey = 1) <> (n_regionkey <> 0) AS y, n_regionkey = 0 AS n, CASE WHEN n_regionkey <> 0 THEN 'yes' ELSE 'no' END AS i, 18446744073709551614::DECIMAL(20,0) AS b, n_nationkey BETWEEN 3 AND 9 AND n_regionkey > 1 AS w FROM nation",
)
mysql(
    "dialect_text", "nation",
    "SELECT n_nationkey, ORD(n_name) AS o, ORD('é') AS e, MAKE_SET(n_regionkey, 'a', 'b', 'c') AS m, INSERT(n_name, 2, 3, '--') AS i, BIN(n_nationkey) AS b, OCT(n_nationkey) AS t FROM nation",
    "SELECT n_nationkey, ascii(n_name)::BIGINT AS o, 50089::BIGINT AS e, concat_ws(',', CASE WHEN n_regionkey & 1 > 0 THEN 'a' END, CASE WHEN n_regionkey & 2 > 0 THEN 'b' END, CASE WHEN n_regionkey & 4 > 0 THEN 'c' END) AS m, left(n_name, 1) || '--' || substr(n_name, 5) AS i, bin(n_nationkey) AS b, format('{:o}', n_nationkey) AS t FROM nation",
)
mysql(
    "dialect_times", "orders",
    "SELECT o_orderkey, TIME_TO_SEC('22:23:00') AS a, SEC_TO_TIME(o_custkey) AS b, PERIOD_DIFF(200802, 0703) AS c, PERIOD_ADD(0801, 2) AS d, MAKEDATE(2011, 32) AS e, WEEK(o_orderdate, 3) AS w FROM orders",
    "SELECT o_orderkey, 80580::BIGINT AS a, lpad((o_custkey // 3600)::VARCHAR, 2, '0') || ':' || lpad((o_custkey // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') AS b, 11::BIGINT AS c, 200803::BIGINT AS d, DATE '2011-02-01' AS e, week(o_orderdate)::INTEGER AS w FROM orders",
)
