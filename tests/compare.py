"""Spark rows against DuckDB rows, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def assert_same(df, sql, sf=SF):
    columns, data = oracle(sql, sf)
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, data)
    assert len(mine) == len(theirs), (len(mine), len(theirs), mine[:2], theirs[:2])
    differ = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not differ, (len(differ), differ[:2])
