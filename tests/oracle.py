"""Compares registered queries with their SQL in DuckDB, as bags of rows with columns sorted by name."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def expected(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, bag(names, got.fetchall())


def difference(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if the query and its SQL agree."""
    df = query(spark, sf_dir)
    names, want = expected(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if got != want:
        return f"{name}: {sum(got.values())} rows and {sum(want.values())}; only here {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
    return ""
