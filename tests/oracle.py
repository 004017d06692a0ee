"""Runs queries beside their SQL in DuckDB and compares names, types' kinds and values."""

from __future__ import annotations

import math
import os

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str:
    found = con.sql(sql)
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} and {sorted(found.columns)}"
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    b = rows(found.columns, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    different = [(x, y) for x, y in zip(a, b, strict=True) if repr(x) != repr(y)]
    return f"{len(different)} of {len(a)} rows differ, as {different[0]}" if different else ""
