"""Compares a query with its SQL twin in DuckDB: names, row count and values, whatever the order."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    assert glob.glob(sf_dir)
    return con


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


def differ(df, con, sql: str) -> str | None:
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    return next((f"{a} against {b}" for a, b in zip(got, want) if a != b), None)
