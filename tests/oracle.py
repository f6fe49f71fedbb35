"""Compares a Spark query with its DuckDB twin on the same Parquet tables."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set memory_limit='6GB'; set max_temp_directory_size='50MB'; set temp_directory='/tmp/duckdb-oracle'")
    for p in sorted(glob.glob(f"{folder}/*.parquet")):
        path = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _plain(x)) for k, x in v.asDict().items())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    ours = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs):
        assert a == b, (a, b)
    return len(ours)
