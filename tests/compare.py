"""Spark rows against DuckDB rows, regardless of order."""

from __future__ import annotations

import os

import duckdb


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    return v if v is None else str(v)


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr([_value(r[c]) for c in names]) for r in df.collect())


def oracle_rows(sql: str, sf: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([_value(x[i]) for i in order]) for x in r.fetchall())


def assert_same(df, sql: str, sf: str) -> None:
    names, want = oracle_rows(sql, sf)
    assert sorted(df.columns) == names
    assert rows_of(df) == want
