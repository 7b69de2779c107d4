"""Aggregate functions with MySQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.numbers import unsigned


def sum_exact(x: Column) -> Column:
    """SUM of integers as a decimal, which cannot overflow like a long."""
    return F.sum(x.cast("decimal(38,0)"))


def sum0(x: Column) -> Column:
    """0 instead of NULL over no rows."""
    return F.coalesce(F.sum(x), F.lit(0))


def avg(x: Column, scale: int = 0) -> Column:
    """Decimal average with four more places than its argument."""
    return F.avg(x.cast(f"decimal(30,{scale})")).cast(f"decimal(38,{scale + 4})")


def bit_and_agg(x: Column) -> Column:
    """All ones over no rows; BIGINT UNSIGNED."""
    return unsigned(F.coalesce(F.bit_and(x.cast("long")), F.lit(-1).cast("long")))


def bit_or_agg(x: Column) -> Column:
    return unsigned(F.coalesce(F.bit_or(x.cast("long")), F.lit(0).cast("long")))


def bit_xor_agg(x: Column) -> Column:
    return unsigned(F.coalesce(F.bit_xor(x.cast("long")), F.lit(0).cast("long")))


def group_concat(x: Column, separator: str = ",", distinct: bool = False, order: Column | None = None, descending: bool = False) -> Column:
    """Texts of a group, ordered by ``order`` (by themselves if None); a distinct text stands at its first place."""
    by = order if order is not None else x
    held = F.filter((F.collect_set if distinct else F.collect_list)(F.struct(by.alias("o"), x.alias("x"))), lambda e: e["x"].isNotNull())
    if distinct and order is not None:
        pairs = F.sort_array(F.transform(held, lambda e: F.struct(e["x"].alias("x"), e["o"].alias("o"))), asc=not descending)
        first = F.filter(pairs, lambda e, i: (i == 0) | (F.get(pairs, i - 1)["x"] != e["x"]))
        held = F.transform(first, lambda e: F.struct(e["o"].alias("o"), e["x"].alias("x")))
    held = F.sort_array(held, asc=not descending)
    return F.when(F.size(held) > 0, F.array_join(F.transform(held, lambda e: e["x"].cast("string")), separator))


def _json(value: Column) -> Column:
    """JSON of the only field of a struct."""
    return F.when(value["x"].isNull(), "null").otherwise(F.regexp_extract(F.to_json(value), r'(?s)^\{"x":(.*)\}$', 1))


def json_arrayagg(x: Column, order: Column | None = None) -> Column:
    """JSON array with its NULLs; NULL over no rows."""
    by = order if order is not None else x
    held = F.sort_array(F.collect_list(F.struct(by.alias("o"), F.struct(x.alias("x")).alias("v"))))
    return F.when(F.size(held) > 0, F.concat(F.lit("["), F.array_join(F.transform(held, lambda e: _json(e["v"])), ","), F.lit("]")))


def json_objectagg(key: Column, value: Column, order: Column | None = None) -> Column:
    """JSON object with its values' own types; the last of equal keys wins, a NULL key is an error."""
    checked = F.when(key.isNull(), F.raise_error(F.lit("JSON documents may not contain NULL member names")).cast("string")).otherwise(key.cast("string"))
    pair = F.concat(_json(F.struct(checked.alias("x"))), F.lit(":"), _json(F.struct(value.alias("x"))))
    held = F.sort_array(F.collect_list(F.struct(checked.alias("k"), (order if order is not None else key).alias("o"), pair.alias("p"))))
    last = F.filter(held, lambda e, i: (i == F.size(held) - 1) | (F.get(held, i + 1)["k"] != e["k"]))
    members = F.sort_array(F.transform(last, lambda e: F.struct(e["o"].alias("o"), e["p"].alias("p"))))
    return F.when(F.size(held) > 0, F.concat(F.lit("{"), F.array_join(F.transform(members, lambda e: e["p"]), ","), F.lit("}")))


def json_array_globalagg(partial: Column, order: Column | None = None) -> Column:
    """Merge JSON arrays of partial aggregates; NULL if there is none."""
    by = order if order is not None else partial
    held = F.sort_array(F.collect_list(F.struct(by.alias("o"), F.regexp_extract(partial, r"(?s)^\s*\[(.*)\]\s*$", 1).alias("p"), partial.isNull().alias("none"))))
    parts = F.filter(held, lambda e: ~e["none"] & (F.trim(e["p"]) != ""))
    return F.when(F.count(partial) > 0, F.concat(F.lit("["), F.array_join(F.transform(parts, lambda e: e["p"]), ","), F.lit("]")))


def json_object_globalagg(partial: Column, order: Column | None = None) -> Column:
    """Merge JSON objects of partial aggregates; of equal keys the last one's value stays."""
    by = order if order is not None else partial
    pairs = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(by.alias("o"), partial.alias("p")))), lambda e: F.transform(F.json_object_keys(e["p"]), lambda k: F.struct(k.alias("k"), F.to_json(F.try_variant_get(F.parse_json(e["p"]), F.lit("$"), "map<string,variant>")[k]).alias("v")))))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["k"] == e["k"]))
    one = lambda e: F.concat(_json(F.struct(e["k"].alias("x"))), F.lit(":"), F.coalesce(e["v"], F.lit("null")))
    return F.when(F.count(partial) > 0, F.concat(F.lit("{"), F.array_join(F.transform(last, one), ","), F.lit("}")))


def checksum(*xs: Column) -> Column:
    """Checksum of a table's rows in any order: sum of row hashes modulo a prime below 2 ** 61.

    Partial checksums add up, so shards can be checked apart and merged.
    """
    row = F.pmod(F.xxhash64(*xs), F.lit((1 << 61) - 1)).cast("decimal(38,0)")
    return (F.sum(row) % F.lit((1 << 61) - 1).cast("decimal(38,0)")).cast("long")


def checksum_merge(partial: Column) -> Column:
    return (F.sum(partial.cast("decimal(38,0)")) % F.lit((1 << 61) - 1).cast("decimal(38,0)")).cast("long")


def hashcheck(*xs: Column) -> Column:
    """BIGINT UNSIGNED hash of the columns of all rows, in any order."""
    return unsigned(F.coalesce(F.bit_xor(F.xxhash64(*xs)), F.lit(0).cast("long")))


def single_value(x: Column) -> Column:
    """The only value of a group; more than one row is an error."""
    return F.when(F.count(F.lit(1)) <= 1, F.first(x)).otherwise(F.raise_error(F.lit("Subquery returns more than 1 row")))


def std(x: Column) -> Column:
    """STD and STDDEV are the population's here."""
    return F.stddev_pop(x)


def variance(x: Column) -> Column:
    return F.var_pop(x)


def hyperloglog(x: Column) -> Column:
    return F.approx_count_distinct(x, 0.01)


def hll_partial(x: Column) -> Column:
    """Sketch that shards compute; ``hll_final`` merges and counts."""
    return F.hll_sketch_agg(x, F.lit(14))


def hll_final(sketch: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def any_row(x: Column) -> Column:
    """Value of a column that is not grouped: it must depend on the group's keys."""
    return F.first(x)


def regr_sxx(y: Column, x: Column) -> Column:
    return F.regr_sxx(y, x)


def regr_syy(y: Column, x: Column) -> Column:
    return F.regr_syy(y, x)
