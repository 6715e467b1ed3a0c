"""Runs registered queries beside their SQL and compares rows."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs; empty if both give the same columns and rows."""
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(a.columns)} and {sorted(b.columns)}"]
    x, y = rows_of(a), rows_of(b)
    if len(x) != len(y):
        return [f"{len(x)} and {len(y)} rows"]
    return [f"{p} and {q}" for p, q in zip(x, y, strict=True) if any(u != v and not (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) < 1.5e-6 * max(1, abs(u))) for u, v in zip(p, q, strict=True))]
