"""Revenue by nation: three joins, a partial/final aggregate and a top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.registry import query
from tidemill.session import table


@query(
    "flagship_revenue_by_nation",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           count(DISTINCT o_orderkey) AS n_orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10
    """,
)
def flagship_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and pruned columns reach the scans; Catalyst picks the join strategies."""
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"))
    joined = (
        line.select("l_orderkey", "l_extendedprice", "l_discount")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return (
        joined.groupBy("n_name")
        .agg(
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.countDistinct("o_orderkey").alias("n_orders"),
        )
        .orderBy(F.desc("revenue"), "n_name")
        .limit(10)
    )
