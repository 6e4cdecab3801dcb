"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(d: str):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows) if False else sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, d: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, d)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connection(d).execute(sql)
    names = [x[0] for x in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return False, f"{len(mine)} and {len(theirs)} rows; only in Spark {list(a - b)[:3]}; only in SQL {list(b - a)[:3]}"
    return True, f"{len(mine)} rows"
