"""Holding queries against their SQL in DuckDB, row by row."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and pd.isna(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "item"):
        return value.item()
    return value


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def differs(df, sql: str, folder: str) -> str:
    """'' if Spark and DuckDB agree, else how they differ."""
    con = connect(folder)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows against {len(want)}; only here {extra}, only there {lack}"
    return ""


__all__ = ["connect", "differs", "rows", "re"]
