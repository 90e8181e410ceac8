"""Compare a query with its DuckDB statement on a folder of tables."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict") or isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in folder.glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return connection


def assert_same(df, connection: duckdb.DuckDBPyConnection, sql: str) -> None:
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[k]) for k in places) for r in cursor.fetchall())
    have = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert have == want, f"only here {list((have - want).elements())[:3]}, only in SQL {list((want - have).elements())[:3]}"
