"""Comparing a Spark result with DuckDB's, whatever the order of rows."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map((lambda x: repr(x + 0.0)) if df[c].dtype.kind == "f" else str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def check(spark, query, sql, folder):
    got, want = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [str(t) for t in got.dtypes] == [str(t) for t in want[got.columns].dtypes]
    a, b = canon(got), canon(want)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(8).to_string()
