"""Column types that Spark lacks: ENUM, SET, YEAR, MEDIUMINT, collated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_order(x: Column, members: list[str]) -> Column:
    """Ordinal of an ENUM member (from 1), by which ENUM columns sort; 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, members)), x), F.lit(0)).cast("long")


def enum_member(n: Column, members: list[str]) -> Column:
    return F.try_element_at(F.array(*map(F.lit, members)), F.nullif(n.cast("int"), F.lit(0)))


def set_members(bits: Column, members: list[str]) -> Column:
    """The members of a SET, in their declared order, from its bits."""
    chosen = [F.when(F.shiftrightunsigned(bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1, F.lit(m)) for i, m in enumerate(members)]
    return F.array_compact(F.array(*chosen))


def set_bits(text: Column, members: list[str]) -> Column:
    """The bits of a SET given as comma-separated members."""
    total = F.lit(0).cast("long")
    for i, m in enumerate(members):
        total = total + F.when(F.find_in_set(F.lit(m), text) > 0, 1 << i).otherwise(0)
    return total


def mediumint(x: Column) -> Column:
    """24 bits; values outside are an error, as in strict mode."""
    fits = x.between(-(1 << 23), (1 << 23) - 1) | x.isNull()
    return F.when(fits, x.cast("int")).otherwise(F.raise_error(F.lit("Out of range value for MEDIUMINT")).cast("int"))


def case_insensitive(x: Column) -> Column:
    """Text that compares, groups and sorts without case."""
    return F.collate(x, "UTF8_LCASE")
