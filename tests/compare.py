"""Compares a query's rows with those of its SQL, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def same_rows(df, con, sql):
    got = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(df.columns)
    at = [got.columns.index(n) for n in names]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())
    mine = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert mine == theirs
