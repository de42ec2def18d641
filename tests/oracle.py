"""Runs registered queries beside their DuckDB text."""

import datetime as dt
import glob
import math
import os


def connect(sf):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    f = float(v)
    return None if math.isnan(f) else round(f, 3) + 0.0


def same(df, rel):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    i = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in i) for r in rel.fetchall()), key=repr)
    return "" if got == want else f"{len(got)} and {len(want)} rows; first difference {next((x for x in zip(got, want) if x[0] != x[1]), None)}"
