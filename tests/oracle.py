"""Compares a query with its SQL in DuckDB: columns by name, rows as a multiset."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else v


def compare(df, sql, con):
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    by = sorted(df.columns)
    got_rows = Counter(tuple(plain(v) for v in r) for r in df.select(*by).collect())
    want_rows = Counter(tuple(plain(v) for v in r) for r in want.select(*(f'"{c}"' for c in by)).fetchall())
    missing, extra = list((want_rows - got_rows).items())[:3], list((got_rows - want_rows).items())[:3]
    assert not missing and not extra, f"missing {missing}\nextra {extra}"
    return sum(got_rows.values())
