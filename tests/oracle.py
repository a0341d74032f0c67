"""Compare a query with its checking SQL: names, types, row count, values in any row order."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame: DataFrame, connection, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty if nothing does."""
    result = connection.sql(sql)
    found = []
    ours = {name: _TYPES.get(dtype, dtype) for name, dtype in frame.dtypes}
    theirs = {n: str(t) for n, t in zip(result.columns, result.types, strict=True)}
    if ours != theirs:
        found.append(f"schema {sorted(set(ours.items()) ^ set(theirs.items()))}")
        if set(ours) != set(theirs):
            return found
    left = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    right = _rows(result.columns, result.fetchall())
    if len(left) != len(right):
        found.append(f"{len(left)} rows against {len(right)}")
    if left != right:
        missing, extra = set(right) - set(left), set(left) - set(right)
        found.append(
            f"{len(extra)} only in Spark, {len(missing)} only in SQL; "
            f"columns {sorted(frame.columns)}; e.g. {sorted(extra)[:2]} / {sorted(missing)[:2]}"
        )
    return found
