"""Runs a query and its SQL and compares rows, as multisets."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.hex() if isinstance(v, (bytes, bytearray)) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def sql_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
