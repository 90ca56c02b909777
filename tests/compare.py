"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (value if value else 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return value


def _sort_key(row):
    return tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, sorted(rows, key=_sort_key)


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_sort_key)


def difference(df, con, sql) -> str | None:
    """None if equal, else a short text about the first difference."""
    left_names, left = spark_rows(df)
    right_names, right = duck_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; first {left[:1]} / {right[:1]}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diffs = [(n, x, y) for n, x, y in zip(left_names, a, b) if x != y or type(x) is not type(y)]
            return f"first differing row: {diffs[:6]}"
    return None
