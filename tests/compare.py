"""Comparison of a Spark result with the answer of DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda row: tuple((v is not None, str(v)) for v in row))


def differences(df, connection, sql: str) -> list[str]:
    """What differs between a frame and a statement; empty when they agree."""
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"]
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(names, answer.fetchall())
    found = []
    if len(mine) != len(theirs):
        found.append(f"rows {len(mine)} against {len(theirs)}")
    header = sorted(names)
    for a, b in zip(mine, theirs):
        if a != b:
            found.append(str([(n, x, y) for n, x, y in zip(header, a, b) if x != y]))
            break
    if not mine:
        found.append("empty")
    return found
