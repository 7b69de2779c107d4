"""Window specifications for the frames of the dialect."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def over(keys: list[str | Column], order: list[str | Column] | None = None) -> WindowSpec:
    spec = Window.partitionBy(*keys)
    return spec.orderBy(*order) if order else spec


def hash_window(value: Column, keys: list[str]) -> Column:
    """Whole-partition window: no order, so no sort of the partition by one."""
    return value.over(Window.partitionBy(*keys))


def rows(keys: list, order: list, low: int, high: int) -> WindowSpec:
    return over(keys, order).rowsBetween(low, high)


def span(keys: list, order: list, low: int, high: int) -> WindowSpec:
    """RANGE frame over a numeric order."""
    return over(keys, order).rangeBetween(low, high)


def ranking(keys: list, order: list, tiles: int = 4) -> dict[str, Column]:
    """All ranking functions over one window."""
    w = over(keys, order)
    return {
        "row_number": F.row_number().over(w).cast("long"),
        "rank": F.rank().over(w).cast("long"),
        "dense_rank": F.dense_rank().over(w).cast("long"),
        "percent_rank": F.percent_rank().over(w),
        "cume_dist": F.cume_dist().over(w),
        "ntile": F.ntile(tiles).over(w).cast("long"),
    }
