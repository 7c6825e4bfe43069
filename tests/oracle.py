"""Compare a registered query with its SQL, run by DuckDB over the same Parquet tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

from geoloom.plans.layers import TABLES


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (datetime, date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql: str):
    result = connection.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def difference(df, connection, sql: str) -> str | None:
    """None when both agree, else what differs first."""
    names, got = spark_rows(df)
    expected_names, expected = sql_rows(connection, sql)
    if names != expected_names:
        return f"columns {names} against {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}; first {got[:2]} against {expected[:2]}"
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ; first {wrong[0][0]} against {wrong[0][1]}"
    return None
