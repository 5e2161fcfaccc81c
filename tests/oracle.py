"""Runs a query in Spark and its SQL in DuckDB, and compares rows without order, as sorted columns."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(v):
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, sf: str, query, sql: str) -> str | None:
    """None if both give the same, else what differs."""
    df = query(spark, sf)
    names = df.columns
    got = rows_of(names, df.collect())
    cur = connect(sf).execute(sql)
    wanted_names = [d[0] for d in cur.description]
    if sorted(names) != sorted(wanted_names):
        return f"columns {sorted(names)} and {sorted(wanted_names)}"
    want = rows_of(wanted_names, cur.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}; columns {sorted(names)}"
    return None
