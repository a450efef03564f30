"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, int) and abs(v) < 2**53 else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in found)


def differences(df, con, sql: str) -> str:
    """Empty if equal."""
    answer = con.execute(sql)
    theirs_columns = [d[0] for d in answer.description]
    theirs = rows(theirs_columns, answer.fetchall())
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} and {sorted(theirs_columns)}"
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}, only theirs {list((theirs - ours).items())[:2]}"
    return ""
