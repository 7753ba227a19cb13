"""Row comparison between a Spark result and the SQL check."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb

from fleetlens.catalog.views import SOURCES


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in SOURCES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return str(value)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None if both give the same columns, types of value and rows; else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    expected = sorted(str([plain(row[i]) for i in at]) for row in rel.fetchall())
    got = sorted(str([plain(row[n]) for n in names]) for row in df.collect())
    if got == expected:
        return None
    only_spark = [r for r in got if r not in set(expected)][:3]
    only_sql = [r for r in expected if r not in set(got)][:3]
    return f"{len(got)} rows, expected {len(expected)}; spark only {only_spark}; sql only {only_sql}"
