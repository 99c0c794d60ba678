"""Results of a query held against DuckDB's of its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([value(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return "None"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 6))
    return str(x)


def rows(df):
    return sorted(tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def duck(sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con.execute(sql).df()


def assert_same(frame, sql):
    a, b = frame.toPandas(), duck(sql)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
