"""A registered query's rows against its SQL's, order aside."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if glob.glob(path + '/*.parquet') else path}'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: list(map(plain, x)) if isinstance(x, (list, tuple)) else bytes(x) if isinstance(x, bytearray) else x
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def same(spark, folder: str, query, sql: str) -> tuple[list, list]:
    df = query(spark, folder)
    want = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    return rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
