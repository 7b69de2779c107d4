"""Operators where a query with an oracle says too little."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.functions import aggregates as A
from tidemill.functions import dates as D
from tidemill.functions import numbers as N
from tidemill.operators import exchange, joins, recursion, rows
from tidemill.plans import registry


def test_not_in_over_an_empty_side_keeps_nulls(spark):
    left = spark.createDataFrame([(1,), (None,)], "a int")
    right = spark.createDataFrame([(1,)], "b int")
    assert joins.not_in(left, right.limit(0), "a", "b").count() == 2
    assert joins.not_in(left, right, "a", "b").count() == 0
    assert joins.not_in(left, spark.createDataFrame([(None,)], "b int"), "a", "b").count() == 0


def test_single_value_and_null_names_are_errors(spark):
    two = spark.range(2)
    with pytest.raises(PySparkException):
        two.agg(A.single_value(F.col("id"))).collect()
    with pytest.raises(PySparkException):
        two.agg(A.json_objectagg(F.lit(None).cast("string"), F.col("id"))).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(N.cot(F.col("id").cast("double"))).collect()


def test_recursion_stops(spark):
    start = spark.createDataFrame([(1,)], "n int")
    assert recursion.recursive(start, lambda d: d.filter("n < 5").select(F.col("n") + 1)).count() == 5
    with pytest.raises(RuntimeError):
        recursion.recursive(start, lambda d: d, most=3)


def test_small_sides_are_counted(spark):
    assert "broadcast" in joins.small(spark.range(10))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.small(spark.range(20), rows=10)._jdf.queryExecution().logical().toString().lower()


def test_a_broadcast_that_is_asked_for_is_counted_too(spark):
    left, few, many = spark.range(10), spark.range(10).toDF("n"), spark.range(100_001).toDF("n")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(joins.join(left, few, [("id", "n")], strategy="broadcast")) and hinted(exchange.exchange(few, "BROADCAST"))
    assert not hinted(joins.join(left, many, [("id", "n")], strategy="broadcast")) and not hinted(exchange.exchange(many, "BROADCAST"))
    assert joins.join(left, many, [("id", "n")], strategy="broadcast").count() == 10


def test_plans_push_down_and_prune(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity < 5").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    top = rows.top_n(df, 3, "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_sketches_are_not_kept_for_each_distinct_value(spark, tmp_path):
    lines = [("A", p % 700) for p in range(2000)] + [(None, p) for p in range(300)] + [("N", None), ("R", 1)]
    spark.createDataFrame(lines, "l_returnflag string, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["agg_hll_exact_bound"](spark, str(tmp_path))
    assert sorted(got.collect(), key=str) == sorted([("A", True), (None, True), ("N", True), ("R", True)], key=str)
    made = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "approx_count_distinct" in x]
    assert made and not any("l_partkey" in x.split("functions=")[0] for x in made)


def test_composite_intervals():
    assert D.composite_interval("1 10", "DAY_HOUR") == {"DAY": 1, "HOUR": 10}
    assert D.composite_interval("-1:30", "MINUTE_SECOND") == {"MINUTE": -1, "SECOND": -30}
    assert D.composite_interval("5", "DAY_SECOND") == {"SECOND": 5}
    assert D.composite_interval("1 2 3", "YEAR_MONTH") == {}
