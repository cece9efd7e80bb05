"""Comparing a DataFrame with what DuckDB makes of the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" if os.path.isfile(f"{sf_dir}/{f}") else f"{sf_dir}/{f}/*.parquet"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, str):
        return v
    return round(float(v), 6)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


def assert_same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
