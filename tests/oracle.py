"""Compares a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}") + 0.0
    return str(x)


def canonical(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


def run_sql(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def assert_same(df: DataFrame, folder: str, sql: str) -> None:
    names, rows = run_sql(folder, sql)
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(names, rows)
