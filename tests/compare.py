"""Runs queries in Spark and their SQL in DuckDB, and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=str)


def duck_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    names = sorted(cols)
    return names, sorted((tuple(norm(r[cols.index(n)]) for n in names) for r in cur.fetchall()), key=str)


def difference(name, queries, oracle, spark, sf):
    a_names, a = spark_rows(queries[name](spark, sf))
    b_names, b = duck_rows(oracle[name], sf)
    if a_names != b_names:
        return f"{name}: columns {a_names} / {b_names}"
    if len(a) != len(b):
        return f"{name}: {len(a)} / {len(b)} rows; first {a[:1]} / {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{name}: {len(bad)} of {len(a)} rows differ: {bad[0]}" if bad else ""
