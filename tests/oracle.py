"""Compares a query with its reference SQL, as the driver does: columns by name,
rows in any order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return db


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "tolist") and hasattr(v, "__len__"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].astype(object).itertuples(index=False))


def same(spark, db, query, sql: str, sf_dir: str) -> None:
    got, want = rows(query(spark, sf_dir).toPandas()), rows(db.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
