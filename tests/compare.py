"""Side-by-side comparison of a query and its SQL."""

from __future__ import annotations

import math

import duckdb

from grievaline.sources.tables import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(frame, con, sql: str) -> str | None:
    """None if both sides hold the same columns and rows, else what differs."""
    cursor = con.execute(sql)
    right_columns = [d[0] for d in cursor.description]
    right = rows_of(right_columns, cursor.fetchall())
    left = rows_of(frame.columns, frame.collect())
    if sorted(frame.columns) != sorted(right_columns):
        return f"columns {sorted(frame.columns)} != {sorted(right_columns)}"
    if left == right:
        return None
    a, b = set(left), set(right)
    return (
        f"{len(left)} vs {len(right)} rows; only left {sorted(a - b)[:2]}; "
        f"only right {sorted(b - a)[:2]}"
    )


def files_read(frame) -> int:
    """How many files the scan of a plain filtered table opens."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()
