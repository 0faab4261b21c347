"""Run one registered query on Spark and its SQL on DuckDB; say where they differ."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 9) or 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (dt.date,)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows),
                  key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, name, query, sql, root):
    df = query(spark, root)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    if len(got) != len(want):
        return f"{name}: {len(got)} rows, want {len(want)}\n  got  {got[:3]}\n  want {want[:3]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{name}: {len(bad)} of {len(got)} rows differ\n  cols {sorted(columns)}\n" + "\n".join(
            f"  got  {g}\n  want {w}" for g, w in bad[:3]), len(got)
    return None, len(got)
