"""Side-by-side comparison of a Spark query with its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    con.execute(sql)
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    want, got = sorted_rows(columns, con.fetchall()), sorted_rows(df.columns, df.collect())
    return [(g, w) for g, w in zip(got, want) if g != w][:5] or ([] if len(got) == len(want) else [(len(got), len(want))])
