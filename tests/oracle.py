"""Runs a query and its DuckDB SQL over the same tables and compares all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, folder: str) -> int:
    """Asserts equal columns and rows; the number of rows."""
    df = query(spark, folder)
    mine = rows_of(df.columns, df.collect())
    result = duck(folder).sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    assert sorted(df.columns) == sorted(result.columns), (df.columns, result.columns)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (sorted(df.columns), a, b)
    return len(mine)
