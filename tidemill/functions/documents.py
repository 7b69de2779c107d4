"""JSON, hash, encryption and UUID functions with MySQL semantics."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- JSON: built from columns, or parsed where no expression reaches --------------


def json_extract(x: Column, path: str) -> Column:
    """``->``: the value as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(x), path, "variant"))


def json_unquote_extract(x: Column, path: str) -> Column:
    """``->>``: the value as text."""
    return F.get_json_object(x, path)


def json_unquote(x: Column) -> Column:
    return F.when(x.rlike('^".*"$'), F.get_json_object(F.concat(F.lit('{"a":'), x, F.lit("}")), "$.a")).otherwise(x)


def json_quote(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("a"))), r'(?s)^\{"a":(".*")\}$', 1)


def json_valid(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("int").cast("long"))


def json_array(*xs: Column) -> Column:
    """Array of values of any types; NULLs are kept."""
    return F.concat(F.lit("["), F.concat_ws(",", *[_value(x) for x in xs]), F.lit("]"))


def json_object(**fields: Column) -> Column:
    pairs = [F.concat(F.lit(json.dumps(k) + ":"), _value(v)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _value(x: Column) -> Column:
    """A value as JSON text, null where it is NULL."""
    return F.when(x.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(x.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1))


def json_length(x: Column, path: str = "$") -> Column:
    """Elements of an array, members of an object, 1 for a scalar."""
    value = F.get_json_object(x, path) if path != "$" else x
    array, keys = F.json_array_length(value), F.size(F.json_object_keys(value))
    return F.when(value.startswith("["), array).when(value.startswith("{"), keys).when(value.isNotNull(), 1).cast("long")


def json_type(x: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(x))
    return (
        F.when(x.isNull(), None)
        .when(kind.startswith("OBJECT"), "OBJECT")
        .when(kind.startswith("ARRAY"), "ARRAY")
        .when(kind == "STRING", "STRING")
        .when(kind == "BIGINT", "INTEGER")
        .when(kind == "BOOLEAN", "BOOLEAN")
        .when(kind == "VOID", "NULL")
        .otherwise("DOUBLE")
    )


def json_storage_size(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def _each(function, *columns: pd.Series) -> pd.Series:
    def one(*values):
        if any(v is None for v in values):
            return None
        try:
            return function(*[json.loads(v) for v in values])
        except ValueError:
            return None

    return pd.Series([one(*v) for v in zip(*columns)], dtype=object)


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(", ", ": "))


def _depth(x) -> int:
    inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return 1 + max(map(_depth, inner), default=0)


def _patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def _preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: _preserve(a[k], v) if k in a else v for k, v in b.items()}}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def _contains(a, b) -> bool:
    if isinstance(a, list):
        return all(any(_contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(_contains(x, b) for x in a)
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and _contains(a[k], v) for k, v in b.items())
    return type(a) is type(b) and a == b


@F.pandas_udf(T.LongType())
def json_depth(x: pd.Series) -> pd.Series:
    return _each(_depth, x)


@F.pandas_udf(T.StringType())
def json_pretty(x: pd.Series) -> pd.Series:
    return _each(lambda v: json.dumps(v, indent=2, ensure_ascii=False), x)


@F.pandas_udf(T.StringType())
def json_merge_patch(a: pd.Series, b: pd.Series) -> pd.Series:
    """RFC 7396."""
    return _each(lambda x, y: _dump(_patch(x, y)), a, b)


@F.pandas_udf(T.StringType())
def json_merge_preserve(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrays are joined, objects merged member by member, scalars wrapped."""
    return _each(lambda x, y: _dump(_preserve(x, y)), a, b)


json_merge = json_merge_preserve


@F.pandas_udf(T.LongType())
def json_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, y: int(_contains(x, y)), a, b)


@F.pandas_udf(T.StringType())
def json_array_append(a: pd.Series, b: pd.Series) -> pd.Series:
    """JSON_APPEND at the root."""
    return _each(lambda x, y: _dump([*(x if isinstance(x, list) else [x]), y]), a, b)



def _append_at(doc, path: str, value):
    """Append where a path of members and positions leads; a path that leads nowhere changes nothing."""
    steps = [m[1] or m[2] or int(m[3]) for m in re.finditer(r'\.(?:"([^"]*)"|(\w+))|\[(\d+)\]', path)]
    root = [doc]
    holder, at = root, 0
    for step in steps:
        inner = holder[at]
        if isinstance(step, int) and not isinstance(inner, list):
            if step:
                return doc
            continue  # a value that is no array is its own first member
        if isinstance(step, int) and step >= len(inner) or isinstance(step, str) and (not isinstance(inner, dict) or step not in inner):
            return doc
        holder, at = inner, step
    old = holder[at]
    holder[at] = [*(old if isinstance(old, list) else [old]), value]
    return root[0]


@F.pandas_udf(T.StringType())
def json_append(a: pd.Series, path: pd.Series, b: pd.Series) -> pd.Series:
    """JSON_APPEND(document, path, JSON value)."""

    def one(x, p, y):
        try:
            return None if x is None or p is None else _dump(_append_at(json.loads(x), p, None if y is None else json.loads(y)))
        except ValueError:
            return None

    return pd.Series([one(x, p, y) for x, p, y in zip(a, path, b)], dtype=object)

# --- hashes, encryption, UUIDs ----------------------------------------------------


def md5(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def sha1(x: Column) -> Column:
    return F.sha1(x.cast("binary"))


def sha2(x: Column, bits: int) -> Column:
    """Length 0 is 256; other lengths than 224, 256, 384 and 512 give NULL."""
    return F.sha2(x.cast("binary"), bits or 256) if bits in (0, 224, 256, 384, 512) else F.lit(None).cast("string")


def folded_key(key: str, size: int = 16) -> bytes:
    """A key of any length folded to the cipher's by XOR."""
    out = bytearray(size)
    for i, c in enumerate(key.encode()):
        out[i % size] ^= c
    return bytes(out)


def aes_encrypt(x: Column, key: str) -> Column:
    return F.aes_encrypt(x.cast("binary"), F.lit(folded_key(key)), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(x: Column, key: str) -> Column:
    return F.try_aes_decrypt(x, F.lit(folded_key(key)), F.lit("ECB"), F.lit("PKCS"))


def uuid_to_bin(x: Column, swap: bool = False) -> Column:
    h = F.replace(x, F.lit("-"), F.lit(""))
    if swap:
        h = F.concat(F.substring(h, 13, 4), F.substring(h, 9, 4), F.substring(h, 1, 8), F.substring(h, 17, 16))
    return F.unhex(h)


def bin_to_uuid(x: Column, swap: bool = False) -> Column:
    h = F.lower(F.hex(x))
    if swap:
        h = F.concat(F.substring(h, 9, 8), F.substring(h, 5, 4), F.substring(h, 1, 4), F.substring(h, 17, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
