"""Every query with an oracle returns the rows, names and kinds of types that DuckDB returns."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tidemill.plans import registry
from tidemill.session import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, duck):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    con = duck.execute(ORACLES[name])
    names = [d[0] for d in con.description]
    expected = con.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, rows) == rows_of(names, expected)
    kinds = {d[0]: str(d[1]).split("(")[0] for d in con.description}
    for column, kind in got.dtypes:
        spark_kind, duck_kind = KINDS.get(kind, kind.split("(")[0].split("<")[0]), kinds[column].lower()
        pairs = {"int": {"bigint", "integer", "smallint", "tinyint"}, "float": {"double", "float"}, "string": {"varchar"}, "decimal": {"decimal"}, "boolean": {"boolean"},
                 "date": {"date"}, "timestamp": {"timestamp", "timestamp with time zone"}, "timestamp_ntz": {"timestamp"}, "binary": {"blob"}, "array": {"list", "array"}}
        if spark_kind in pairs and rows:
            assert any(duck_kind.startswith(k) or duck_kind.endswith("[]") for k in pairs[spark_kind]), (column, kind, duck_kind)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(name, spark):
    QUERIES[name](spark, SF).collect()
