"""Rows of a Spark query against those of DuckDB on the same tables."""

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x if x is None or isinstance(x, (bool, str, bytes)) else int(x) if isinstance(x, int) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    got = connect(sf_dir).execute(sql)
    theirs = rows([d[0] for d in got.description], got.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in got.description)
    assert mine == theirs
