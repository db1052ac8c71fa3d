"""Holding a query's rows against what DuckDB makes of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def held(spark, query, sql: str, sf_dir: str) -> None:
    """Asserts equal columns, types and rows in any order."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.sql(sql), query(spark, sf_dir)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert {n: KINDS.get(t, t) for n, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    at = [want.columns.index(n) for n in names]
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
