"""Planar geometry on plain columns: WKT, envelopes, centroids, and the predicates of polygons.

A geometry is ``rings``, an array of closed rings of (x, y) structs (a point is one ring of one point), and its envelope in
``xmin, ymin, xmax, ymax``. Orientation tests are in double arithmetic, exact for coordinates of few bits.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
Ring = list[tuple[float, float]]


def parse_wkt(text: str) -> list[Ring]:
    """Rings of a POINT or POLYGON text; an outer ring first, closed if it was not."""
    m = re.fullmatch(r"\s*(POINT|POLYGON)\s*(\(.*\))\s*", text, re.I | re.S)
    if not m:
        raise ValueError(f"not a point or polygon: {text[:80]!r}")
    body = m[2] if m[1].upper() == "POLYGON" else f"({m[2]})"
    rings = [[(float(x), float(y)) for x, y in (p.split()[:2] for p in r.split(","))] for r in re.findall(r"\(([^()]+)\)", body)]
    if not rings:
        raise ValueError(f"no coordinates in {text[:80]!r}")
    return [r if len(r) == 1 or r[0] == r[-1] else [*r, r[0]] for r in rings]


def rings_of(rings: list[Ring]) -> Column:
    """Rings as a constant column."""
    point = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    return F.array(*[F.array(*[point(p) for p in r]) for r in rings])


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The rings of a rectangle whose corners may come in any order."""
    a, b, c, d = F.least(xmin, xmax), F.least(ymin, ymax), F.greatest(xmin, xmax), F.greatest(ymin, ymax)
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(p(a, b), p(c, b), p(c, d), p(a, d), p(a, b)))


def point(x: Column, y: Column) -> Column:
    return F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))))


def with_envelope(df: DataFrame, rings: str = "rings") -> DataFrame:
    outer = F.element_at(rings, 1)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return df.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def as_text(rings: Column) -> Column:
    """WKT: a point if there is one point, else a polygon."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(",", F.transform(r, pair)), F.lit(")"))
    body = F.concat_ws(",", F.transform(rings, ring))
    return F.when(F.size(F.element_at(rings, 1)) == 1, F.concat(F.lit("POINT"), body)).otherwise(F.concat(F.lit("POLYGON("), body, F.lit(")")))


def contains_point(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a polygon's interior: by the even-odd rule, a point on the boundary is not. Native."""

    def sides(r: Column) -> Column:
        step = lambda i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b"))
        return F.transform(F.sequence(F.lit(1), F.size(r) - 1), step)

    edges = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), sides))
    turn = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    on = lambda e: (turn(e) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    # An edge counts if it spans the point's height, its lower end included, and lies to its right.
    hit = lambda e: ((e["a"]["y"] <= y) != (e["b"]["y"] <= y)) & ((turn(e) > 0) == (e["b"]["y"] > e["a"]["y"]))
    return ~F.exists(edges, on) & (F.size(F.filter(edges, hit)) % 2 == 1)


def _edges(rings: list) -> np.ndarray:
    out = [(*a, *b) for r in rings for a, b in zip(r[:-1], r[1:]) if a != b]
    return np.array(out, float).reshape(-1, 4)


def _place(points: np.ndarray, e: np.ndarray) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside, for each point."""
    if not len(e):
        return np.full(len(points), -1)
    x, y = points[:, :1], points[:, 1:]
    ax, ay, bx, by = e.T
    t = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    on = (t == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
    hit = ((ay <= y) != (by <= y)) & ((t > 0) == (by > ay))
    return np.where(on.any(1), 0, np.where(hit.sum(1) % 2 == 1, 1, -1))


def _middles(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The middles of the pieces into which the edges f cut the edges e."""
    out = []
    for ax, ay, bx, by in e:
        cuts = [0.0, 1.0]
        dx, dy = bx - ax, by - ay
        for cx, cy, ex, ey in f:
            ux, uy = ex - cx, ey - cy
            d = dx * uy - dy * ux
            if d:
                t, s = ((cx - ax) * uy - (cy - ay) * ux) / d, ((cx - ax) * dy - (cy - ay) * dx) / d
                if 0 < t < 1 and 0 <= s <= 1:
                    cuts.append(t)
            elif (cx - ax) * dy == (cy - ay) * dx:
                n = dx * dx + dy * dy
                cuts += [t for t in (((cx - ax) * dx + (cy - ay) * dy) / n, ((ex - ax) * dx + (ey - ay) * dy) / n) if 0 < t < 1]
        cuts.sort()
        out += [(ax + dx * (s + t) / 2, ay + dy * (s + t) / 2) for s, t in zip(cuts[:-1], cuts[1:]) if s < t]
    return np.array(out, float).reshape(-1, 2)


def _meet(e: np.ndarray, f: np.ndarray) -> bool:
    ends = np.vstack([e[:, :2], e[:, 2:]]), np.vstack([f[:, :2], f[:, 2:]])
    if (_place(ends[0], f) == 0).any() or (_place(ends[1], e) == 0).any():
        return True
    side = lambda p, q: np.sign((q[:, 2] - q[:, 0]) * (p[1] - q[:, 1]) - (q[:, 3] - q[:, 1]) * (p[0] - q[:, 0]))
    for a in e:
        one = a[None, :]
        cross = (side(a[:2], f) * side(a[2:], f) < 0) & (np.array([side(b[:2], one)[0] * side(b[2:], one)[0] for b in f]) < 0)
        if cross.any():
            return True
    return False


def relate(a: list, b: list) -> tuple[bool, bool]:
    """(a within b, a touches b) of two geometries given by rings."""
    ea, eb = _edges(a), _edges(b)
    if not len(ea) or not len(eb):
        if not len(ea) and not len(eb):
            return a[0][0] == b[0][0], False
        p, e, first = (a[0][0], eb, True) if not len(ea) else (b[0][0], ea, False)
        at = _place(np.array([p], float), e)[0]
        return bool(first and at > 0), bool(at == 0)
    pa, pb = _place(_middles(ea, eb), eb), _place(_middles(eb, ea), ea)
    if (pa > 0).any() or (pb > 0).any():
        shared = True
    elif (pa < 0).any() and (pb < 0).any() or not (_meet(ea, eb)):
        shared = False
    else:
        shared = not (pa < 0).any() and not (pb < 0).any()  # the same boundary
    within = shared and not (pa < 0).any() and not (pb > 0).any()
    return within, not shared and _meet(ea, eb)


def _tuples(rings) -> list:
    return [[(p["x"], p["y"]) for p in r] for r in rings]


def relation(a: Column, b: Column) -> Column:
    """A struct ``within, touches`` of two polygon columns: an Arrow function, for candidate pairs only."""

    @F.pandas_udf("within boolean, touches boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([relate(_tuples(p), _tuples(q)) for p, q in zip(x, y)], columns=["within", "touches"])

    return run(a, b)


def from_wkt(text: Column) -> Column:
    """Rings of a WKT column; null for null."""

    @F.pandas_udf(RINGS)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else [[{"x": p, "y": q} for p, q in r] for r in parse_wkt(t)])

    return run(text)


def centroid(parts: DataFrame, key: str) -> DataFrame:
    """The area centroid of each key's polygons: shoelace sums within each row, added up by key; no vertex is sent. Holes count negative; what has no area
    has no centroid."""

    def sums(ring: Column) -> Column:
        side = lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        none = F.struct(*[F.lit(0.0).alias(k) for k in ("d", "sx", "sy")])
        add = lambda s, e: F.struct((s["d"] + e["c"]).alias("d"), (s["sx"] + e["x"] * e["c"]).alias("sx"), (s["sy"] + e["y"] * e["c"]).alias("sy"))
        return F.aggregate(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), side), none, add)

    rings = F.transform("rings", lambda r, k: F.struct(sums(r).alias("s"), F.when(k == 0, 1).otherwise(-1).alias("sign")))
    total = lambda k: F.aggregate("r", F.lit(0.0), lambda t, x: t + F.signum(x["s"]["d"]) * x["sign"] * x["s"][k])
    rows = parts.select(key, rings.alias("r")).select(key, *[total(k).alias(k) for k in ("d", "sx", "sy")])
    out = rows.groupBy(key).agg(*[F.sum(k).alias(k) for k in ("d", "sx", "sy")])
    return out.select(key, *[F.try_divide(F.col(f"s{k}"), 3 * F.col("d")).alias(k) for k in ("x", "y")])
