"""Compares a query's rows with DuckDB's for its SQL."""

import math
import os

import duckdb


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v).replace("+00:00", "")


def same(df, sql, folder, tables=None):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    for name, frame in (tables or {}).items():
        con.register(name, frame)
    rows = con.sql(sql)
    assert sorted(rows.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    have = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    assert have == want
