"""Compare a query with its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = [None if x is None or x is pd.NA or x != x else str(round(float(x), 6)) if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, (bool, np.bool_)) else str(x) for x in df[c].astype(object)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got, sql, con):
    want = con.execute(sql).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))
