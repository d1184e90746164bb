"""Jaro-Winkler similarity, which Spark does not have: an Arrow function over pairs of columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """The published measure: prefix weight 0.1, a prefix of 4 at most, for what is over 0.7 without it. Of two empty strings 1."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(left, (c for c, k in zip(b, taken) if k))) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def best_name(names: Column, label: Column) -> Column:
    """The largest similarity of the label to one of the ``|``-separated names."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else max(jaro_winkler(n, q) for n in p.split("|")) for p, q in zip(x, y)], dtype="float64")

    return run(names, label)
