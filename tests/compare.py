"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(x):
    if x is None or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(x, float):
        return repr(x + 0.0)
    return repr(x.item() if hasattr(x, "item") else x) if not isinstance(x, str) else x


def table_of(frame):
    columns = sorted(frame.columns)
    rows = sorted((tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)
    return columns, rows


def difference(spark_df, sql: str, con) -> str:
    """Empty if both agree."""
    got = table_of(spark_df.toPandas())
    want = table_of(con.execute(sql).fetchdf())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}; only here: {[r for r in got[1] if r not in set(want[1])][:2]}, only there: {[r for r in want[1] if r not in set(got[1])][:2]}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b and not all(close(x, y) for x, y in zip(a, b))]
    return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}" if wrong else ""


def close(x, y) -> bool:
    if x == y:
        return True
    try:
        return abs(float(x) - float(y)) <= 1e-9 * max(1.0, abs(float(x)))
    except (TypeError, ValueError):
        return False
