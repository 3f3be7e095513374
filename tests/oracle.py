"""Comparing a query with its SQL over the same Parquet files."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, found):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    return names, [dict(zip(names, r, strict=True)) for r in done.fetchall()]


def same(df, sql, sf_dir):
    names, expected = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows(sorted(names), df.collect()) == rows(sorted(names), expected)
