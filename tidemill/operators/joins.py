"""Joins. Catalyst chooses the physical join unless a strategy is asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strategy names and the hints they stand for; a broadcast is a hint only for a side that ``small`` has counted.
STRATEGIES = {
    "broadcast": "broadcast", "bka": "shuffle_hash", "merge": "merge", "hash": "shuffle_hash",
    "nested_loop": "shuffle_replicate_nl", "auto": None,
}


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", residual: Column | None = None, strategy: str = "auto") -> DataFrame:
    """Equi join with an optional residual condition, by the strategy that is asked for.

    A right side that is too large to be broadcast is joined as Catalyst chooses.
    """
    condition = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in on])
    hint = STRATEGIES[strategy]
    hinted = small(right) if hint == "broadcast" else right.hint(hint) if hint else right
    return left.join(hinted, condition if residual is None else condition & residual, how)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a side only if a count of at most ``rows + 1`` rows shows that it is small."""
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(rows + 1).collect()) <= rows else df


def semi(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], strategy: str = "auto") -> DataFrame:
    return join(left, right, on, "left_semi", strategy=strategy)


def anti(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], strategy: str = "auto") -> DataFrame:
    """NOT EXISTS: unmatched rows, those with a NULL key among them."""
    return join(left, right, on, "left_anti", strategy=strategy)


def not_in(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """NOT IN with its NULLs: nothing if the right side has one, no row with a NULL key unless it is empty.

    The right side's NULLs and emptiness are one aggregate row, so the join itself stays
    an equi join that scales.
    """
    facts = right.agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col(other).isNull().cast("int")).alias("_nulls"))
    kept = left.join(right.select(F.col(other).alias("_other")).distinct(), F.col(key) == F.col("_other"), "left_anti")
    return kept.crossJoin(F.broadcast(facts)).filter("_rows = 0 OR (_nulls = 0)").filter((F.col("_rows") == 0) | F.col(key).isNotNull()).drop("_rows", "_nulls")


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Any condition: a nested loop over a broadcast right side; use ``ranges`` where the condition is a range."""
    return left.join(small(right), condition, how)


def ranges(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the spans that contain them (low <= at < high), as an equi join on buckets of ``width``."""
    bucketed = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return (
        points.withColumn("_bucket", F.floor(F.col(at) / width))
        .join(bucketed, "_bucket")
        .filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
        .drop("_bucket")
    )


def salted(left: DataFrame, right: DataFrame, key: str, other: str, salts: int = 16) -> DataFrame:
    """Inner join of a left side with hot keys: its rows are spread over ``salts`` copies of the right side."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, (a[key] == b[other]) & (a["_salt"] == b["_salt"])).drop("_salt")


def group_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], aggregates: list[Column], how: str = "left") -> DataFrame:
    """Join and aggregate by the join key in one go."""
    return join(left, right, on, how).groupBy(*[left[a] for a, _ in on]).agg(*aggregates)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The latest right value at or before each left row: one sort by key and time, no pair of rows is built."""
    from pyspark.sql import Window

    both = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, at, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    latest = F.last("_value", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, latest).filter("_side = 1").drop("_side", "_value")
