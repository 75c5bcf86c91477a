"""Rows of a query against those of its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def _shown(value) -> str:
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def same_rows(con, df, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(_shown(r[c]) for c in names) for r in df.collect())
    found = con.sql(sql)
    columns = list(found.columns)
    assert sorted(columns) == names
    want = sorted(tuple(_shown(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert got == want
