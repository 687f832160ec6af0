"""Run a query and its SQL over the same tables and compare: names, row counts, values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


def differences(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    data = [tuple(r) for r in got.collect()]
    found = connect(sf_dir).execute(sql)
    columns, expected = [d[0] for d in found.description], found.fetchall()
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(columns)}"
    a, b = rows(got.columns, data), rows(columns, expected)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
