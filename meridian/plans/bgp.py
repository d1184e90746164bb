"""Graph patterns as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparql import Pattern, is_var

Scan = Callable[[Pattern], DataFrame]


def bindings(pattern: Pattern, scan: Scan) -> DataFrame:
    """One pattern: constants are filters before any join; a variable that occurs twice is an equality."""
    df = scan(pattern)
    for column, term in (("subject", pattern.subject), ("object", pattern.object)):
        if not is_var(term):
            df = df.where(F.col(column) == term)
    if pattern.subject == pattern.object and is_var(pattern.subject):
        return df.where("subject = object").select(F.col("subject").alias(pattern.subject[1:]))
    return df.select(*[F.col(c).alias(t[1:]) for c, t in (("subject", pattern.subject), ("object", pattern.object)) if is_var(t)])


def components(patterns: list[Pattern]) -> list[list[Pattern]]:
    """Patterns connected by variables."""
    groups: list[tuple[set[str], list[Pattern]]] = []
    for p in patterns:
        names = {t for t in (p.subject, p.object) if is_var(t)}
        joined = [g for g in groups if g[0] & names]
        groups = [g for g in groups if not g[0] & names]
        groups.append((names.union(*(g[0] for g in joined)), [*[x for g in joined for x in g[1]], p]))
    return [g[1] for g in groups]


def plan(patterns: list[Pattern], scan: Scan) -> list[DataFrame]:
    """One frame of distinct bindings for each connected component.

    Patterns with more constants come first, then whatever shares a variable with what is there; all shared variables
    are join keys, so cycles are closed. Sizes are left to the optimizer and to adaptive execution.
    """
    out = []
    for group in components(patterns):
        left = sorted(group, key=lambda p: is_var(p.subject) + is_var(p.object))
        df = bindings(left.pop(0), scan)
        while left:
            nxt = next(p for p in left if {p.subject[1:], p.object[1:]} & set(df.columns) or not any(map(is_var, (p.subject, p.object))))
            left.remove(nxt)
            other = bindings(nxt, scan)
            keys = [c for c in other.columns if c in df.columns]
            df = df.join(other, keys) if keys else df.join(other.limit(1), how="left_semi", on=F.lit(True))
        out.append(df.distinct())
    return out
