"""Comparing a Spark result with DuckDB's, row by row in any order."""

import math
from pathlib import Path

import duckdb


def plain(x):
    if x is None or isinstance(x, (str, bool, bytes)):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x if isinstance(x, int) else str(x)


def rows_of_spark(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr), names


def rows_of_duckdb(sql, data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.sql(sql)
    names = sorted(got.columns)
    at = [got.columns.index(c) for c in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr), names
