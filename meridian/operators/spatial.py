"""Spatial joins as equi-joins on grid cells, refined by exact predicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G
from .reasoner import ensure_checkpoints

BOX = ("xmin", "ymin", "xmax", "ymax")


def _cells(df: DataFrame, size: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return df.withColumn("cx", F.explode(span("xmin", "xmax"))).withColumn("cy", F.explode(span("ymin", "ymax")))


def cell_size(*tables: DataFrame) -> float:
    """The larger of the tables' mean extents, so that an envelope covers few cells; 1 where all are points."""
    most = 0.0
    for t in tables:
        w, h = t.agg(F.avg(F.col("xmax") - F.col("xmin")), F.avg(F.col("ymax") - F.col("ymin"))).collect()[0]
        most = max(most, w or 0.0, h or 0.0)
    return most or 1.0


def candidates(left: DataFrame, right: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs whose envelopes meet, each once: columns of ``left`` with ``l_``, of ``right`` with ``r_``. Cells are of ``size``, or that of cell_size(right).

    Both sides go to the cells that their envelopes cover; a pair that meets in several cells stays in the one that has the lower
    left corner of the common envelope, so no distinct is needed. No pair is compared outside a cell.
    """
    size = size or cell_size(right)
    a = _cells(left, size).select([F.col(c).alias(f"l_{c}") if c not in ("cx", "cy") else F.col(c) for c in [*left.columns, "cx", "cy"]])
    b = _cells(right, size).select([F.col(c).alias(f"r_{c}") if c not in ("cx", "cy") else F.col(c) for c in [*right.columns, "cx", "cy"]])
    x, y = F.greatest("l_xmin", "r_xmin"), F.greatest("l_ymin", "r_ymin")
    j = a.join(b, ["cx", "cy"]).where((x <= F.least("l_xmax", "r_xmax")) & (y <= F.least("l_ymax", "r_ymax")))
    return j.where((F.floor(x / size) == F.col("cx")) & (F.floor(y / size) == F.col("cy"))).drop("cx", "cy")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of ``points(x, y, ...)`` and ``polygons(rings, ...)`` where the polygon's interior has the point. All native."""
    p = points.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})
    return candidates(p, polygons, size).where(G.contains_point(F.col("r_rings"), F.col("l_x"), F.col("l_y")))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float | None = None) -> DataFrame:
    """As points_in_polygons, for envelopes; their edges are outside too."""
    p = points.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})
    c = candidates(p, boxes, size)
    return c.where((F.col("l_x") > F.col("r_xmin")) & (F.col("l_x") < F.col("r_xmax")) & (F.col("l_y") > F.col("r_ymin")) & (F.col("l_y") < F.col("r_ymax")))


def _chosen(geoms: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Geometries whose id is in ``ids(id)``: a semi-join, which prunes as the planner sees fit."""
    return geoms if ids is None else geoms.join(ids, "id", "left_semi")


def containment(geoms: DataFrame, parents: DataFrame, children: DataFrame | None = None, size: float | None = None) -> DataFrame:
    """``parent, child``: every part of the child lies within the parent, or they are the same entity.

    Parts are counted for each pair, so a child may have several parents and a part may lie in several of a parent's parts.
    """
    p, c = _chosen(geoms, parents), _chosen(geoms, children)
    pairs = candidates(c, p, size).where("l_id <> r_id")
    hit = pairs.where(G.relation(F.col("l_rings"), F.col("r_rings"))["within"])
    done = hit.groupBy(F.col("r_id").alias("parent"), F.col("l_id").alias("child")).agg(F.count_distinct("l_part_id").alias("n"), F.first("l_count").alias("of")).where("n = of")
    same = p.select(F.col("id").alias("parent")).distinct().join(c.select(F.col("id").alias("child")).distinct(), F.col("parent") == F.col("child"))
    return done.select("parent", "child").unionByName(same)


def adjacency(geoms: DataFrame, parents: DataFrame, children: DataFrame | None = None, size: float | None = None) -> DataFrame:
    """``parent, child``: some part of one touches some part of the other."""
    pairs = candidates(_chosen(geoms, children), _chosen(geoms, parents), size).where("l_id <> r_id")
    hit = pairs.where(G.relation(F.col("l_rings"), F.col("r_rings"))["touches"])
    return hit.select(F.col("r_id").alias("parent"), F.col("l_id").alias("child")).distinct()


def within_window(geoms: DataFrame, rings: list) -> DataFrame:
    """``child``: entities all of whose parts lie in a constant polygon. The envelope test is a plain filter on the scan."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    near = geoms.where((F.col("xmin") >= min(xs)) & (F.col("xmax") <= max(xs)) & (F.col("ymin") >= min(ys)) & (F.col("ymax") <= max(ys)))
    hit = near.where(G.relation(F.col("rings"), G.rings_of(rings))["within"])
    return hit.groupBy(F.col("id").alias("child")).agg(F.count_distinct("part_id").alias("n"), F.first("count").alias("of")).where("n = of").select("child")


def in_window(regions: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Geometries that share a point with a rectangle, its corners in any order."""
    a, b, c, d = min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)
    near = regions.where((F.col("xmax") >= a) & (F.col("xmin") <= c) & (F.col("ymax") >= b) & (F.col("ymin") <= d))
    window = G.rings_of([[(a, b), (c, b), (c, d), (a, d), (a, b)]])
    rel, back = G.relation(F.col("rings"), window), G.relation(window, F.col("rings"))
    # Neither inside the other nor touching: their boundaries cross, or they are apart; crossing shows in the corners' middles.
    inside = (F.col("xmin") >= a) & (F.col("xmax") <= c) & (F.col("ymin") >= b) & (F.col("ymax") <= d)
    return near.where(inside | rel["within"] | rel["touches"] | back["within"] | crosses(F.col("rings"), window))


def crosses(a: Column, b: Column) -> Column:
    """Whether two geometries' boundaries meet."""
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(len(e) and len(f) and G._meet(e, f)) for e, f in ((G._edges(G._tuples(p)), G._edges(G._tuples(q))) for p, q in zip(x, y))], dtype=bool)

    return run(a, b)


def touching(regions: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of different regions of one table that touch, in both orders."""
    pairs = candidates(regions, regions, size).where("l_id <> r_id")
    return pairs.where(G.relation(F.col("l_rings"), F.col("r_rings"))["touches"]).select(F.col("l_id").alias("region_id1"), F.col("r_id").alias("region_id2")).distinct()


def disconnected(ids: DataFrame, touching_pairs: DataFrame) -> DataFrame:
    """``id1, id2``: unordered pairs of different ids that do not touch. The result itself is quadratic in the regions."""
    other = ids.select(F.col("id").alias("id2"))
    pairs = ids.select(F.col("id").alias("id1")).join(other, F.col("id1") < F.col("id2"))
    ec = touching_pairs.select(F.least("region_id1", "region_id2").alias("id1"), F.greatest("region_id1", "region_id2").alias("id2")).distinct()
    return pairs.join(ec, ["id1", "id2"], "left_anti")


def nearest(points: DataFrame, sites: DataFrame, size: float | None = None) -> DataFrame:
    """``subject, id, distance``: each point's nearest site; ties go to the smaller id. Points and sites without a place (null or NaN) take no part.

    A search over grids: a point looks into the nine cells around it. What is found within a cell's length cannot be beaten from outside; the other
    points go on in cells twice as large, until nine cells hold everything. A round is checkpointed; no pair is made of all points and all sites.
    """
    spark = points.sparkSession
    ensure_checkpoints(spark)
    there = lambda df: df.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    left, s = there(points.select("subject", "x", "y")), there(sites.select("id", "x", "y")).checkpoint()
    bound = lambda df: df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).collect()[0]
    (a, b, c, d, n), (e, f, g, h, m) = bound(s), bound(left)
    if not n or not m:
        return left.select("subject", F.lit(None).cast(s.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("distance")).limit(0)
    span = max(max(b, f) - min(a, e), max(d, h) - min(c, g), 1e-9)
    # At first a cell holds about two sites, if they lie evenly.
    size, out = size or max(span / max(1.0, (n / 2) ** 0.5), 1e-9), None
    while True:
        cell = lambda v: F.floor(v / size).cast("long")
        there_ = s.select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
        near = left.withColumn("cx", F.explode(F.sequence(cell(F.col("x")) - 1, cell(F.col("x")) + 1)))
        near = near.withColumn("cy", F.explode(F.sequence(cell(F.col("y")) - 1, cell(F.col("y")) + 1)))
        d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
        got = near.join(there_, ["cx", "cy"]).groupBy("subject", "x", "y").agg(F.min(F.struct(d.alias("distance"), F.col("id"))).alias("m"))
        settled = got.where((F.col("m.distance") <= size) | F.lit(size >= span)).select("subject", "x", "y", F.col("m.id").alias("id"), F.col("m.distance").alias("distance")).checkpoint()
        out = settled.drop("x", "y") if out is None else out.unionByName(settled.drop("x", "y"))
        if size >= span:
            return out
        left = left.join(settled, ["subject", "x", "y"], "left_anti").checkpoint()
        if not left.limit(1).count():
            return out
        size *= 2


def related_to_window(geoms: DataFrame, rings: list, relation: str) -> DataFrame:
    """``child``: entities of which some part touches a constant polygon, or contains it."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    near = geoms.where((F.col("xmax") >= min(xs)) & (F.col("xmin") <= max(xs)) & (F.col("ymax") >= min(ys)) & (F.col("ymin") <= max(ys)))
    window = G.rings_of(rings)
    hit = G.relation(F.col("rings"), window)["touches"] if relation == "touches" else G.relation(window, F.col("rings"))["within"]
    return near.where(hit).select(F.col("id").alias("child")).distinct()
