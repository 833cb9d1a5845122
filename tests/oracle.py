"""Runs a query and its SQL over the smallest tables and compares values."""

from __future__ import annotations

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}/*.parquet" if os.path.isdir(f"{DATA}/{name}") else f"{DATA}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def _plain(value):
    if isinstance(value, float):
        return repr(value)
    return "[" + ",".join(map(_plain, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


def same(spark, connection, run, sql: str) -> None:
    df = run(spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(_plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
