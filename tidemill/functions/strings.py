"""String functions with MySQL semantics."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lit(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(x: Column) -> Column:
    """Bytes; CHAR_LENGTH counts characters."""
    return F.octet_length(x).cast("long")


def char_length(x: Column) -> Column:
    return F.char_length(x).cast("long")


def bit_length(x: Column) -> Column:
    return F.bit_length(x).cast("long")


def ascii_(x: Column) -> Column:
    return F.ascii(x).cast("long")


def ord_(x: Column) -> Column:
    """Code of the first character: its bytes in base 256."""
    first = F.hex(F.encode(F.substring(x, 1, 1), "utf-8"))
    return F.coalesce(F.conv(F.nullif(first, F.lit("")), 16, 10).cast("long"), F.when(x.isNotNull(), F.lit(0).cast("long")))


def bin_(x: Column) -> Column:
    return F.bin(x.cast("long"))


def oct_(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


def hex_(x: Column) -> Column:
    return F.hex(x)


def char(*codes: Column) -> Column:
    """The bytes of the codes (unsigned 32 bits, without leading zeros); NULLs are skipped."""

    def one(n: Column) -> Column:
        h = F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.when(n.isNull(), "").otherwise(F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h))

    return F.unhex(F.concat(*[one(c) for c in codes]))


def concat(*xs: Column) -> Column:
    return F.concat(*xs)


def concat_ws(separator: str, *xs: Column) -> Column:
    return F.concat_ws(separator, *xs)


def elt(n: Column, *items: Column) -> Column:
    """NULL outside of the list."""
    return F.when(n >= 1, F.try_element_at(F.array(*items), n.cast("int")))


def field(x: Column, *items: Column) -> Column:
    """Position of x, 0 if it is absent or NULL."""
    at = F.lit(0)
    for i in reversed(range(len(items))):
        at = F.when(x == items[i], i + 1).otherwise(at)
    return at.cast("long")


def find_in_set(x: Column, listed: Column) -> Column:
    return F.find_in_set(x, listed).cast("long")


def format_(x: Column, digits: int) -> Column:
    return F.format_number(x, digits)


def to_base64(x: Column) -> Column:
    return F.base64(x.cast("binary"))


def from_base64(x: Column) -> Column:
    return F.unbase64(x).cast("string")


def insert(x: Column, position: int, size: int, new: Column) -> Column:
    """Replace ``size`` characters from ``position``; outside of the text nothing changes."""
    n = F.char_length(x)
    tail = F.lit(0) if size < 0 else F.greatest(n - F.lit(position + size - 1), F.lit(0))
    changed = F.concat(F.substring(x, 1, position - 1), new, F.right(x, tail) if size >= 0 else F.lit(""))
    return F.when((F.lit(position) <= 0) | (F.lit(position) > n), x).otherwise(changed)


def instr(x: Column, part: str) -> Column:
    return F.instr(x, part).cast("long")


def locate(part: str, x: Column, start: int = 1) -> Column:
    return F.locate(part, x, start).cast("long")


def left(x: Column, n: int) -> Column:
    return F.left(x, F.lit(max(n, 0)))


def right(x: Column, n: int) -> Column:
    return F.right(x, F.lit(max(n, 0)))


def lower(x: Column) -> Column:
    return F.lower(x)


def upper(x: Column) -> Column:
    return F.upper(x)


def lpad(x: Column, n: int, pad: str) -> Column:
    """Cut when longer; NULL for a negative size."""
    return F.lpad(x, n, pad) if n >= 0 else F.lit(None).cast("string")


def rpad(x: Column, n: int, pad: str) -> Column:
    return F.rpad(x, n, pad) if n >= 0 else F.lit(None).cast("string")


def trim(x: Column) -> Column:
    return F.trim(x)


def ltrim(x: Column) -> Column:
    return F.ltrim(x)


def rtrim(x: Column) -> Column:
    return F.rtrim(x)


def make_set(bits: Column, *items: Column) -> Column:
    """The items whose bit is set, joined by commas; NULL items are skipped."""
    chosen = [F.when(F.shiftrightunsigned(bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1, x) for i, x in enumerate(items)]
    return F.when(bits.isNotNull(), F.concat_ws(",", *chosen))


def quote(x: Column) -> Column:
    """A literal; NULL gives the text NULL."""
    escaped = x
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\x1a", "\\Z")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def repeat(x: Column, n: int) -> Column:
    return F.repeat(x, max(n, 0))


def replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def reverse(x: Column) -> Column:
    return F.reverse(x)


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), F.greatest(n.cast("int"), F.lit(0)))


def soundex(x: Column) -> Column:
    return F.soundex(x)


def sounds_like(a: Column, b: Column) -> Column:
    return (F.soundex(a) == F.soundex(b)).cast("int").cast("long")


def substring(x: Column, position: int, size: int | None = None) -> Column:
    """From a one-based position, from the end if negative; position 0 gives the empty text."""
    if position == 0 or size is not None and size <= 0:
        return F.when(x.isNotNull(), F.lit(""))
    n = F.char_length(x)
    start = F.lit(position) if position > 0 else n + 1 + position
    taken = F.substr(x, start, F.lit(size) if size is not None else n)
    return F.when(start < 1, F.lit("")).otherwise(taken)


def substring_index(x: Column, delimiter: str, count: int) -> Column:
    return F.substring_index(x, delimiter, count)


@F.pandas_udf(T.BinaryType())
def compress(x: pd.Series) -> pd.Series:
    """Length in four bytes (little-endian) and a zlib stream; empty stays empty."""
    raw = x.map(lambda v: None if v is None else bytes(v, "utf-8") if isinstance(v, str) else bytes(v))
    return raw.map(lambda b: None if b is None else b"" if not b else len(b).to_bytes(4, "little") + zlib.compress(b))


@F.pandas_udf(T.BinaryType())
def uncompress(x: pd.Series) -> pd.Series:
    """The text of ``compress``; NULL if the bytes are not its output."""

    def one(b):
        if b is None or not len(b):
            return b
        try:
            return zlib.decompress(bytes(b)[4:])
        except zlib.error:
            return None

    return x.map(one)


def uncompressed_length(x: Column) -> Column:
    low = F.conv(F.hex(F.reverse(F.substring(x, 1, 4))), 16, 10)
    return F.when(F.octet_length(x) < 4, 0).otherwise(low.cast("long")).cast("long")


def equal_ci(a: Column, b: Column) -> Column:
    """Equality under the default, case-insensitive collation."""
    return F.collate(a, "UTF8_LCASE") == F.collate(b, "UTF8_LCASE")


def convert_using(x: Column, charset: str) -> Column:
    """CONVERT(x USING charset): characters outside of it become '?'."""
    return F.decode(F.encode(x, charset), charset)
