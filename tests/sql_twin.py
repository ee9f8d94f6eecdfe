"""Compares a query with its SQL twin, whatever the order of rows and columns."""

import decimal
from pathlib import Path

import duckdb
import numpy as np


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
