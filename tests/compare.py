"""Compare a Spark result with a DuckDB result: columns, row count, values in any order."""

from __future__ import annotations

import math

import duckdb

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, float):
        return (1, format(round(v, 6) + 0.0, ".6f"))
    if hasattr(v, "isoformat"):
        return (2, v.isoformat())
    return (1, str(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short report."""
    columns = spark_df.columns
    ours = _rows(columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} != {sorted(names)}"
    kinds = {n: str(d[1]) for n, d in zip(names, result.description)}
    expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {
        n: (t, kinds[n]) for n, t in spark_df.dtypes if t in expected and expected[t] != kinds[n]
    }
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}; types {wrong}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}; types {wrong}"
    return f"types {wrong}" if wrong else None
