"""Arithmetic, mathematics and bit operators with MySQL semantics under ANSI mode."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_null(*xs: Column) -> Column:
    return reduce(lambda a, b: a | b, [x.isNull() for x in xs])


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """Division of the operands as they are, with four digits more than the dividend at least; x / 0 is NULL."""
    return F.try_divide(a * F.lit(Decimal("1.0000")), b)


def int_divide(a: Column, b: Column) -> Column:
    """DIV: quotient cut towards zero; NULL for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def mod(a: Column, b: Column) -> Column:
    """MOD: sign of the dividend; NULL for a zero divisor."""
    return F.try_mod(a, b)


def unary_minus(x: Column) -> Column:
    return -x


def unary_plus(x: Column) -> Column:
    return x


def coalesce(*xs: Column) -> Column:
    return F.coalesce(*xs)


def greatest(*xs: Column) -> Column:
    """NULL if any argument is."""
    return F.when(_any_null(*xs), None).otherwise(F.greatest(*xs))


def least(*xs: Column) -> Column:
    return F.when(_any_null(*xs), None).otherwise(F.least(*xs))


def interval(n: Column, *bounds: Column) -> Column:
    """Index of the first bound above n, -1 for NULL; NULL bounds are passed over."""
    at = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        at = F.when(bounds[i] > n, i).otherwise(at)
    return F.when(n.isNull(), -1).otherwise(at).cast("long")


# --- mathematics ----------------------------------------------------------------


def acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def asin(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


def atan(y: Column, x: Column | None = None) -> Column:
    return F.atan(y) if x is None else F.atan2(y, x)


def cot(x: Column) -> Column:
    return F.when(F.tan(x) == 0, F.raise_error(F.lit("DOUBLE value is out of range in 'cot'")).cast("double")).otherwise(F.cot(x))


def crc32(x: Column) -> Column:
    return F.crc32(x.cast("string").cast("binary"))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log(x: Column, y: Column | None = None) -> Column:
    """One argument: natural logarithm; two: the first is the base."""
    if y is None:
        return ln(x)
    return F.when((x > 0) & (x != 1) & (y > 0), F.ln(y) / F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def pow_(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def special_pow(x: Column, y: Column) -> Column:
    """POW that gives 0 for a base of zero or less under a fractional exponent below one."""
    return F.when((x <= 0) & (y >= 0) & (y < 1), F.lit(0.0)).otherwise(F.pow(x, y))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def truncate(x: Column, digits: int) -> Column:
    """Cut towards zero after ``digits`` places (to the left for negative ones)."""
    scaled = x.cast("decimal(38,10)")
    if digits >= 0:
        step = F.lit(10**digits).cast("decimal(20,0)")
        return (F.sign(scaled).cast("int") * F.floor(F.abs(scaled) * step) / step).cast(f"decimal(30,{min(digits, 10)})")
    step = F.lit(10**-digits).cast("decimal(20,0)")
    return (F.sign(scaled).cast("int") * F.floor(F.abs(scaled) / step) * step).cast("decimal(30,0)")


def round_(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def conv(x: Column, base: int, to: int) -> Column:
    return F.conv(x.cast("string"), base, to)


# --- bits -----------------------------------------------------------------------


def unsigned(x: Column) -> Column:
    """The 64 bits of a long as BIGINT UNSIGNED, a DECIMAL(20, 0)."""
    wide = x.cast("decimal(20,0)")
    return F.when(x >= 0, wide).otherwise((wide + F.lit(Decimal(2**64))).cast("decimal(20,0)"))


def signed(x: Column) -> Column:
    """A BIGINT UNSIGNED back to the long with the same bits."""
    wide = x.cast("decimal(20,0)")
    limit, wrap = F.lit(Decimal(2**63)), F.lit(Decimal(2**64))
    return F.when(wide < limit, wide.try_cast("long")).otherwise((wide - wrap).try_cast("long"))


def bit_and(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseAND(b.cast("long")))


def bit_or(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseOR(b.cast("long")))


def bit_xor(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseXOR(b.cast("long")))


def bit_not(x: Column) -> Column:
    return unsigned(F.bitwise_not(x.cast("long")))


def shift_left(x: Column, n: int) -> Column:
    """Shifts beyond 63 bits (or below none) give 0."""
    return unsigned(F.shiftleft(x.cast("long"), n)) if 0 <= n <= 63 else F.when(x.isNotNull(), F.lit(0).cast("decimal(20,0)"))


def shift_right(x: Column, n: int) -> Column:
    return unsigned(F.shiftrightunsigned(x.cast("long"), n)) if 0 <= n <= 63 else F.when(x.isNotNull(), F.lit(0).cast("decimal(20,0)"))


def bit_count(x: Column) -> Column:
    return F.bit_count(x.cast("long")).cast("long")
