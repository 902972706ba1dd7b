"""Holds a query's rows against those of its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data):
    names = sorted(columns)
    return sorted((tuple(plain(dict(zip(columns, r))[n]) for n in names) for r in data), key=repr)


def expected(sf_dir, sql):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return sorted(found.columns), rows(found.columns, found.fetchall())


def actual(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
