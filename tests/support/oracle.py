"""Compares a query's rows with its SQL's, run by DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    tidy = lambda x: None if x is None or x is pd.NA or isinstance(x, float) and x != x else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(tidy(x.item() if hasattr(x, "item") else x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)


def same(spark_frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree, else what differs."""
    a, b = spark_frame.toPandas(), con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows_of(a), rows_of(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    return next((f"{p} and {q}" for p, q in zip(x, y, strict=True) if p != q), "")
