"""Compares a Spark result with DuckDB's on the same tables, whatever the order of rows."""

import math
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype == bool:
        return str(bool(x))
    try:
        return repr(round(float(x), 6)) if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in r) for r in frame.itertuples(index=False))


def same(spark_frame, con, sql):
    got, want = spark_frame.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
