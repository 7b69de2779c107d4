"""Recursive common table expressions as a fixpoint of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, most: int = 1000, limit: int | None = None) -> DataFrame:
    """UNION [ALL] recursion: ``step`` gets the rows of the last round, rows have the anchor's types.

    Lineage is cut after each round by a reliable checkpoint where the session has a
    checkpoint folder, so plans stay small over deep recursions.
    """
    context = anchor.sparkSession.sparkContext
    cut = (lambda df: df.checkpoint()) if context.getCheckpointDir() else (lambda df: df.persist())
    last = cut(anchor)
    total, rounds = last, 0
    count = last.count()
    while count and rounds < most and (limit is None or total.count() < limit):
        new = step(last)
        new = new.select(*[new[a].cast(f.dataType).alias(f.name) for a, f in zip(new.columns, anchor.schema.fields)])
        if distinct:
            new = new.distinct().join(total, [new[c].eqNullSafe(total[c]) for c in new.columns], "left_anti")
        last = cut(new)
        count = last.count()
        if count:
            total = total.unionByName(last)
        rounds += 1
    if count and rounds >= most:
        raise RuntimeError(f"recursion did not end after {most} rounds")
    return total if limit is None else total.limit(limit)
