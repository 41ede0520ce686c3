"""Spark results against the same query in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connection(root):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(d):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    d = d[sorted(d.columns)]
    return list(d.columns), sorted(tuple(text(v) for v in r) for r in d.itertuples(index=False))


def same(got, con, sql):
    assert canonical(got.toPandas()) == canonical(con.execute(sql).df())
