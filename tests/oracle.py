"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> list:
    got = rows(df.columns, df.collect())
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    if sorted(df.columns) != sorted(d[0] for d in found.description):
        return [("columns", df.columns, [d[0] for d in found.description])]
    if len(got) != len(want):
        return [("rows", len(got), len(want), got[:2], want[:2])]
    return [(a, b) for a, b in zip(got, want) if a != b][:3]
