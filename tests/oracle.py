"""Spark results against DuckDB over the same parquet files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in data)


def assert_same(df, con, sql):
    got = df.collect()
    rel = con.execute(sql)
    want_columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(want_columns)
    assert rows(df.columns, got) == rows(want_columns, rel.fetchall())
