"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


def rows_of(df) -> tuple[list[str], list[tuple]]:
    order = sorted(df.columns)
    return order, sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
