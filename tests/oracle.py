"""Runs registered queries beside their SQL on the same tables."""

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = round(float(v), 9)
        return 0.0 if v == 0 else v
    return v


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    at = [names.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want), key=str)
    diff = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]
    assert len(a) == len(b), (len(a), len(b), diff)
    assert not diff, diff
    return len(a)
