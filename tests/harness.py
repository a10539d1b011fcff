"""Compares a query with its SQL: columns, types and rows."""

import datetime
import math
from pathlib import Path

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, found):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted(([plain(r[i]) for i in at] for r in found), key=repr)


def compare(df, sql, connection):
    result = connection.execute(sql)
    columns, kinds = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    expected = rows(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    for name, kind in df.dtypes:
        assert TYPES.get(kind, kind) == kinds[name], name
    assert rows(df.columns, df.collect()) == expected
