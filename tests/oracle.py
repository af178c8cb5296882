"""Compares a frame with the rows of a DuckDB statement, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

from millrace.catalog import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        path = Path(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float | decimal.Decimal):
        return "nan" if math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return tuple(plain(v) for v in value) if isinstance(value, list | tuple) else value


def same_rows(frame, con, statement: str) -> None:
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    columns = sorted(names)
    expected = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    found = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    assert found == expected
