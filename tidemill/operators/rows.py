"""Sort, limit, set operations and materialisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Total order by a range exchange and a sort in each range, which spills."""
    return df.orderBy(*keys)


def top_n(df: DataFrame, n: int, *keys: Column | str, offset: int = 0) -> DataFrame:
    """The first rows after an offset: each task keeps n + offset rows, one merges them."""
    ordered = df.orderBy(*keys)
    return ordered.offset(offset).limit(n) if offset else ordered.limit(n)


def top_n_per_group(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """Catalyst pushes the rank limit below the exchange, so a hot group ships n rows a task."""
    from pyspark.sql import Window

    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(n) if offset else df.limit(n)


def nulls_low(name: str, descending: bool = False) -> Column:
    """NULL sorts below every value."""
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first()


def union_all(*parts: DataFrame) -> DataFrame:
    """Columns by position, types widened to a common one."""
    return reduce(DataFrame.union, parts)


def union(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def intersect(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    return a.intersectAll(b) if keep_all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_all else a.subtract(b)


def cached(df: DataFrame) -> DataFrame:
    """Materialised once and replayed; spills to disk, and lost parts are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
