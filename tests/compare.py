"""Comparison of a registered query with its SQL counterpart."""

import datetime
import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows) -> list:
    """Rows with columns sorted by name, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, db) -> list[str]:
    found = db.sql(sql)
    expected_columns = found.columns
    if sorted(df.columns) != sorted(expected_columns):
        return [f"columns {sorted(df.columns)} != {sorted(expected_columns)}"]
    mine = rows_of(df.columns, df.collect())
    theirs = rows_of(expected_columns, found.fetchall())
    if mine == theirs:
        return []
    only_mine = [r for r in mine if r not in set(theirs)][:2]
    only_theirs = [r for r in theirs if r not in set(mine)][:2]
    return [f"{len(mine)} rows vs {len(theirs)}", f"only here {str(only_mine)[:1500]}", f"only SQL {str(only_theirs)[:1500]}"]
