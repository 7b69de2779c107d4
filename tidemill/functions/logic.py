"""Predicates and logical operators with MySQL truth values (0, 1, NULL as long)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """A boolean as 1, 0 or NULL."""
    return condition.cast("int").cast("long")


def truthy(x: Column) -> Column:
    """Numeric truth: non-zero; text counts by its leading number, so 'true' is false."""
    return number(x) != 0


def number(x: Column) -> Column:
    """Leading number of a value as double, 0 where there is none."""
    text = x.cast("string")
    lead = F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))", 1)
    boolean = F.typeof(x) == "boolean"
    plain = F.when(boolean & (text == "true"), F.lit("1")).when(boolean, F.lit("0")).otherwise(text)
    return F.when(x.isNull(), None).otherwise(F.coalesce(plain.try_cast("double"), lead.try_cast("double"), F.lit(0.0)))


def not_(x: Column) -> Column:
    return flag(~(x != 0))


def and_(*xs: Column) -> Column:
    return flag(reduce(lambda a, b: a & b, [x != 0 for x in xs]))


def or_(*xs: Column) -> Column:
    """``||`` is OR here, not concatenation."""
    return flag(reduce(lambda a, b: a | b, [x != 0 for x in xs]))


def xor_(a: Column, b: Column) -> Column:
    return flag((a != 0) != (b != 0))


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """IF: a condition that is NULL or zero gives the last argument."""
    return F.when(F.coalesce(truthy(condition), F.lit(False)), yes).otherwise(no)


def case(*args: Column) -> Column:
    """CASE WHEN: pairs of condition and value, and perhaps a value for the rest."""
    out = F.when(truthy(args[0]), args[1])
    for condition, value in zip(args[2:-1:2], args[3::2]):
        out = out.when(truthy(condition), value)
    return out.otherwise(args[-1]) if len(args) % 2 else out


def is_true(x: Column) -> Column:
    return flag(F.coalesce(truthy(x), F.lit(False)))


def is_not_true(x: Column) -> Column:
    return 1 - is_true(x)


def is_false(x: Column) -> Column:
    return flag(F.coalesce(~truthy(x), F.lit(False)))


def is_not_false(x: Column) -> Column:
    return 1 - is_false(x)


def eq(a: Column, b: Column) -> Column:
    return flag(a == b)


def ne(a: Column, b: Column) -> Column:
    return flag(a != b)


def null_safe_eq(a: Column, b: Column) -> Column:
    """``<=>``: NULL equals NULL."""
    return flag(a.eqNullSafe(b))


def between(x: Column, low: Column, high: Column) -> Column:
    """Three-valued: FALSE already if one bound decides."""
    return flag((x >= low) & (x <= high))


def not_between(x: Column, low: Column, high: Column) -> Column:
    return flag(~((x >= low) & (x <= high)))


def in_(x: Column, *items: Column) -> Column:
    """NULL if nothing matches and an item (or x) is NULL."""
    return flag(reduce(lambda a, b: a | b, [x == i for i in items]))


def not_in(x: Column, *items: Column) -> Column:
    return 1 - in_(x, *items)


def row_eq(left: list[Column], right: list[Column]) -> Column:
    """Row comparison, three-valued: FALSE if one pair differs, else NULL if one is unknown."""
    return flag(reduce(lambda a, b: a & b, [a == b for a, b in zip(left, right, strict=True)]))


def row_in(left: list[Column], rows: list[list[Column]]) -> Column:
    return flag(reduce(lambda a, b: a | b, [row_eq(left, r) != 0 for r in rows]))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0).cast("long")


def like(x: Column, pattern: str) -> Column:
    return flag(x.like(pattern))


def not_like(x: Column, pattern: str) -> Column:
    return flag(~x.like(pattern))


def regexp(x: Column, pattern: str, whole: bool = False) -> Column:
    """Partial match as in MySQL; ``whole`` asks for a match of the whole text."""
    return flag(x.rlike(f"^(?:{pattern})$" if whole else pattern))


def not_regexp(x: Column, pattern: str, whole: bool = False) -> Column:
    return 1 - regexp(x, pattern, whole)
