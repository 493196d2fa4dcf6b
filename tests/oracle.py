"""Comparison of a query with its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).iterdir():
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, float)):
        return float(f"{float(x):.9g}")
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same_rows(df, sql: str, folder: str, least: int = 1) -> None:
    con = duck(folder)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
    assert len(want) >= least
