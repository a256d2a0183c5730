"""Compares a query with its SQL: columns by name, rows in any order, floats to nine digits."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None:
        return None
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def difference(df: DataFrame, sql: str, sf_dir: str) -> str | None:
    got = rows(df.columns, df.collect())
    with connect(sf_dir) as c:
        r = c.sql(sql)
        want = rows(r.columns, r.fetchall())
        if sorted(df.columns) != sorted(r.columns):
            return f"columns {df.columns} and {r.columns}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {got[:3]} {want[:3]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else None
