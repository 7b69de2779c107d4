"""Scans and row generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prune(df: DataFrame, columns: list[str], predicate: Column | None = None) -> DataFrame:
    """Filter and projection at the scan; both reach the file reader."""
    return (df if predicate is None else df.filter(predicate)).select(*columns)


def sorted_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Each split in order of the keys, without a shuffle."""
    return df.sortWithinPartitions(*keys)


def lookup(inner: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``inner`` whose key is among ``keys``: the batched key access of a lookup join."""
    return inner.join(keys.select(on).distinct(), on, "left_semi")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def empty(df: DataFrame) -> DataFrame:
    return df.limit(0)


def sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample, repeatable for the same input splits and seed."""
    return df.sample(False, fraction, seed)


def sample_by_key(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Bernoulli sample by a hash of the key: repeatable for any layout of the input."""
    return df.filter(F.crc32(F.col(key).cast("string").cast("binary")) % 100 < percent)


def list_rows(spark: SparkSession, name: str, items: list) -> DataFrame:
    """One row for each item of a list."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, items))).alias(name))


def cartesian(*parts: DataFrame) -> DataFrame:
    """All combinations of short lists (row generators for IN-list pruning)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out
