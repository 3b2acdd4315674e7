"""Compare a Spark result with a DuckDB result: same columns, rows as multisets."""

from __future__ import annotations

import datetime as dt
import math


def _norm(v, digits=6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "__float__") and not isinstance(v, (int, bool)):
        return round(float(v), digits) + 0.0
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = rel.fetchall()
    return [names[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    c1, r1 = spark_rows(df)
    c2, r2 = duck_rows(con, sql)
    assert c1 == c2, (c1, c2)
    assert len(r1) == len(r2), (len(r1), len(r2))
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    assert not bad, bad[:5]
