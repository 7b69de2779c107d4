"""Aggregation operators beyond ``groupBy``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand(df: DataFrame, projections: list[list[Column]], names: list[str]) -> DataFrame:
    """Each row once for every list of expressions."""
    rows = F.array(*[F.struct(*[c.alias(n) for c, n in zip(p, names, strict=True)]) for p in projections])
    return df.select(F.explode(rows).alias("_row")).select("_row.*")


def grouping_sets(df: DataFrame, sets: list[list[str]], keys: list[str], *aggregates: Column) -> DataFrame:
    """GROUPING SETS with their keys as columns."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggregates)


def two_phase(df: DataFrame, keys: list[str], partial: list[Column], final: list[Column], salts: int = 16) -> DataFrame:
    """Aggregate by salted keys first, then merge: a hot key is shared by ``salts`` tasks.

    Catalyst's own partial aggregates already do this for algebraic functions; this form
    is for states that grow with a group, such as lists.
    """
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return salted.groupBy(*keys, "_salt").agg(*partial).groupBy(*keys).agg(*final)


def sorted_aggregate(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregate over input that is sorted by its keys."""
    return df.repartition(*keys).sortWithinPartitions(*keys).groupBy(*keys).agg(*aggregates)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


def first_of(df: DataFrame, keys: list[str], *dependent: str) -> DataFrame:
    """SELECT of columns that are not grouped: they must depend on the keys."""
    return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in dependent])
