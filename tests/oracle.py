"""Runs a query's SQL in DuckDB over the driver's tables, and compares rows without their order."""

import glob
import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connected(folder=FOLDER):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 9) if isinstance(value, float) else value


def same(df, sql, folder=FOLDER):
    """Whether a DataFrame has the rows and columns that the SQL gives."""
    found = connected(folder).sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    got = [r.asDict() for r in df.collect()]
    key = lambda rows: sorted(repr([plain(r[c]) for c in columns]) for r in rows)
    return key(got) == key(want)
