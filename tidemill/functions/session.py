"""Functions of the session; their values differ from run to run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version() -> Column:
    return F.version()


def current_user() -> Column:
    return F.current_user()


def database() -> Column:
    return F.current_database()


def current_time_zone() -> Column:
    return F.current_timezone()


def rand(seed: int | None = None) -> Column:
    return F.rand(seed) if seed is not None else F.rand()


def uuid() -> Column:
    return F.expr("uuid()")


def random_bytes(n: int) -> Column:
    """Between 1 and 1024 random bytes."""
    if not 1 <= n <= 1024:
        raise ValueError("random_bytes takes 1 to 1024")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.floor(F.rand() * 256).cast("long")), 2, "0") for _ in range(n)]))


def charset(x: Column) -> Column:
    return F.when(x.isNotNull(), F.lit("utf8mb4"))


def collation(x: Column) -> Column:
    return F.collation(x)


def benchmark(times: int, x: Column) -> Column:
    """Evaluates nothing more than once here; the result is 0."""
    return F.when(x.isNull() | x.isNotNull(), F.lit(0))
