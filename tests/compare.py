"""Rows of a query against the rows of its SQL in DuckDB."""

import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if not isinstance(v, (int, bool, type(None))) else v


def assert_same(spark, run, sql):
    df = run(spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = connect().sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert got == want
