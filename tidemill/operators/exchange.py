"""Exchanges between stages, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tidemill.operators import joins


def exchange(df: DataFrame, mode: str, *keys: str | Column, parts: int | None = None) -> DataFrame:
    """RANDOM, PARTITION (by hash of keys), RANGE, SINGLE, DIRECT or BROADCAST distribution.

    Without ``parts`` the session's shuffle partitions hold and adaptive execution merges
    small ones. SINGLE is for results that are small already, such as final aggregates.
    BROADCAST is a hint only behind the count of ``joins.small``.
    """
    if mode == "RANDOM":
        return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if mode == "PARTITION":
        return df.repartition(parts, *keys) if parts else df.repartition(*keys)
    if mode == "RANGE":
        return df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    if mode == "SINGLE":
        return df.coalesce(1)
    if mode == "BROADCAST":
        return joins.small(df)
    if mode == "DIRECT":
        return df
    raise ValueError(f"unknown exchange {mode}")
