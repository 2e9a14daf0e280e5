"""Runs a query and its SQL, and compares the rows whatever their order."""

from __future__ import annotations

import decimal
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def cell(v) -> str:
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 9) + 0.0)
    return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


def same(spark, folder: str, build, sql: str) -> None:
    df = build(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    result = connect(folder).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert ours == rows(names, result.fetchall())
