"""Data changes as new tables: UPDATE, DELETE, REPLACE, and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows with new values where the condition is true; assignments see the old row."""
    return df.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (false or unknown)."""
    return df.filter(F.coalesce(~condition, F.lit(True)))


def replace(df: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """REPLACE INTO: new rows take the place of those with the same keys.

    Of new rows with one key the last stays: the greatest by ``order``, or by all other
    columns. A key with a NULL is like no other.
    """
    rest = [c for c in df.columns if c not in keys]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    last = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest)) if rest else F.lit(None)
    newest = rows.filter(known).groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
    new = newest.unionByName(rows.filter(~known).select(*df.columns))
    return df.join(rows.select(*keys).filter(known), keys, "left_anti").select(*df.columns).unionByName(new)


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE; in ``values`` new columns are prefixed with ``new_``."""
    new = rows.select(*[F.col(c).alias(f"new_{c}") for c in rows.columns])
    match = [F.col(k) == F.col(f"new_{k}") for k in keys]
    kept = df.join(new, match, "left")
    changed = update(kept, F.col(f"new_{keys[0]}").isNotNull(), **values).select(*df.columns)
    return changed.unionByName(rows.join(df.select(*keys), keys, "left_anti").select(*df.columns))


def numbered(df: DataFrame, name: str, *order: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in an order, without gathering the rows in one task.

    Rows are sorted by range; each range's count, one row a range, gives its offset.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("_offset"))
    return local.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + F.col("_at")).alias(name))
