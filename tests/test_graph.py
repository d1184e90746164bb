"""The algebra, the parser, geometry, and the queries against their SQL."""

import math
import random

import oracle
import pytest

from meridian.functions import rcc8, similarity
from meridian.operators import geometry, reasoner
from meridian.plans import catalogue, sparql

C = rcc8.Calculus()


def test_algebra():
    assert len(C.reachable({64, 8, 24, 2, 6})) == 36 and len(C.reachable({1 << i for i in range(8)})) == 37
    for a in range(1, 256, 7):
        for b in (1, 8, 24, 64, 130, 255):
            assert C.converse(C.compose(a, b)) == C.compose(C.converse(b), C.converse(a))
            assert C.compose(a, rcc8.EQ) == a
    assert rcc8.mask(rcc8.numbers(0b10100110)) == 0b10100110
    with pytest.raises(ValueError):
        rcc8.Calculus.parse("1 2\n1 2\n1 1 1")


def closed(spark, rows, source):
    net = reasoner.symmetrise(spark.createDataFrame(rows, "lhs long, rel int, rhs long"), C)
    out = reasoner.closure(net, spark.createDataFrame([(source,)], "lhs long"), C)
    return {r["rhs"]: r["rel"] for r in out.collect()}


def test_reasoner(spark):
    assert closed(spark, [(0, 8, 1), (1, 8, 2), (2, 8, 3)], 3) == {0: 2, 1: 2, 2: 2}
    assert closed(spark, [(0, 64, 3), (0, 8, 4), (2, 64, 3), (2, 64, 4)], 4)[3] == rcc8.mask([3, 6])
    assert closed(spark, [(0, 64, 2), (0, 64, 3), (1, 8, 3), (2, 24, 3)], 2)[1] == rcc8.mask([1, 2, 3, 6, 7])
    with pytest.raises(reasoner.Inconsistent):
        closed(spark, [(0, 8, 1), (1, 8, 2), (2, 8, 0)], 0)


def box(a, b, c, d):
    return [[(a, b), (c, b), (c, d), (a, d), (a, b)]]


def test_polygons():
    big, inner = box(0, 0, 10, 10), box(2, 2, 3, 3)
    holed = [*big, *box(2, 2, 3, 3)]
    assert geometry.relate(inner, big) == (True, False) and geometry.relate(big, inner) == (False, False)
    assert geometry.relate(big, big) == (True, False)
    assert geometry.relate(box(10, 10, 12, 12), big) == (False, True) and geometry.relate(box(10, 2, 12, 3), big) == (False, True)
    assert geometry.relate(box(9, 9, 12, 12), big) == (False, False) and geometry.relate(box(11, 11, 12, 12), big) == (False, False)
    assert geometry.relate(inner, holed) == (False, True)
    assert geometry.relate([[(10, 5)]], big) == (False, True) and geometry.relate([[(2.5, 2.5)]], holed) == (False, False)
    assert geometry.relate(box(2, 0, 4, 10), box(0, 3, 10, 5)) == (False, False)
    assert geometry.parse_wkt("POLYGON((0 0,1 0,1 1))") == [[(0, 0), (1, 0), (1, 1), (0, 0)]]


def test_parser():
    q = sparql.parse('PREFIX s: <http://schema.org/> PREFIX g: <http://www.opengis.net/ont/geosparql#> SELECT DISTINCT ?x WHERE { ?x a s:Museum ; s:name "a"@en, "b" . ?x g:sfWithin <http://e/1>. FILTER(g:sfWithin(?x, "POLYGON((0 0,1 0,1 1,0 0))"^^g:wktLiteral)) } ORDER BY ?x LIMIT 3')
    assert len(q.plain) == 3 and q.spatial[0].relation == "within" and q.windows == [("?x", "POLYGON((0 0,1 0,1 1,0 0))", "within")] and q.limit == 3 and q.distinct
    assert len(sparql.parse_file("SELECT ?a WHERE { ?a <http://p> ?b }\n-----\n \n-----")) == 1
    for bad in ("SELECT ?a WHERE { OPTIONAL { ?a <p> ?b } }", "ASK { ?a <p> ?b }", "SELECT ?a WHERE { ?a ?p ?b }"):
        with pytest.raises(sparql.Unsupported):
            sparql.parse(bad)
    with pytest.raises(ValueError):
        sparql.parse("SELECT ?z WHERE { ?a <http://p> ?b }")


def test_parser_of_groups():
    q = sparql.parse("SELECT * WHERE { ?a <http://p> ?b . { ?a <http://q> ?c } UNION { ?a <http://r> ?c . OPTIONAL { ?c <http://s> ?d } } OPTIONAL { ?b <http://t> ?e } } LIMIT 3 OFFSET 2")
    assert q.select == ["?a", "?b", "?c", "?d", "?e"] and len(q.unions[0]) == 2 and len(q.unions[0][1].optionals) == 1 and (q.limit, q.offset) == (3, 2)
    # ?c may be unbound before the second part joins on it.
    for bad in ("{ ?a <p:> ?b OPTIONAL { ?a <q:> ?c } OPTIONAL { ?c <r:> ?d } }", "{ ?a <p:> ?b { ?a <q:> ?c } UNION { ?a <r:> ?d } { ?c <s:> ?e } }"):
        with pytest.raises(sparql.Unsupported):
            sparql.parse("SELECT * WHERE " + bad)


def test_nearest(spark):
    from meridian.operators import spatial

    rng = random.Random(2)
    sites = [(f"s{i}", rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(300)] + [("far", 900.0, 900.0), ("none", None, 1.0)]
    points = [(f"p{i}", rng.uniform(-1, 2), rng.uniform(-1, 2)) for i in range(60)] + [("q", 5000.0, 880.0), ("null", None, 3.0), ("nan", float("nan"), 3.0)]
    got = {r["subject"]: (r["id"], r["distance"]) for r in spatial.nearest(spark.createDataFrame(points, "subject string, x double, y double"), spark.createDataFrame(sites, "id string, x double, y double")).collect()}
    want = {}
    for k, x, y in points[:-2]:
        d, site = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, s) for s, a, b in sites[:-1])
        want[k] = (site, d)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    empty = spark.createDataFrame([], "id string, x double, y double")
    assert spatial.nearest(spark.createDataFrame(points, "subject string, x double, y double"), empty).count() == 0


def test_centroid_of_a_long_ring_and_a_hole(spark):
    n = 100_000
    circle = [(5 + 2 * math.cos(2 * math.pi * i / n), 7 + 2 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rows = [("circle", [[*circle, circle[0]]]), ("holed", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 0.0)]]), ("point", [[(1.0, 1.0)]])]
    got = {r["id"]: (r["x"], r["y"]) for r in geometry.centroid(spark.createDataFrame(rows, f"id string, rings {geometry.RINGS}"), "id").collect()}
    assert got["circle"] == pytest.approx((5, 7), abs=1e-6) and got["holed"] == pytest.approx((1, 2)) and got["point"] == (None, None)


def test_polygons_that_are_no_boxes(spark):
    """Stars with holes against points, one crowded cell among empty ones: by rays in plain Python."""
    from meridian.operators import spatial

    rng = random.Random(8)

    def star(cx, cy, r, n=9):
        ring = [(cx + (r if i % 2 else r / 2) * math.cos(math.pi * i / n), cy + (r if i % 2 else r / 2) * math.sin(math.pi * i / n)) for i in range(2 * n)]
        return [*ring, ring[0]]

    areas = [(f"a{i}", [star(x := rng.uniform(0, 3), y := rng.uniform(0, 3), 1.0), star(x, y, 0.3)]) for i in range(12)] + [("huge", [star(500, 500, 700)])]
    points = [(f"p{i}", rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(400)]

    def inside(rings, x, y):
        hits = 0
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                hits += (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
        return hits % 2 == 1

    table = geometry.with_envelope(spark.createDataFrame(areas, f"id string, rings {geometry.RINGS}"))
    found = spatial.points_in_polygons(spark.createDataFrame(points, "subject string, x double, y double"), table)
    assert {(r["l_subject"], r["r_id"]) for r in found.collect()} == {(p, a) for p, x, y in points for a, rings in areas if inside(rings, x, y)}


def test_reasoner_skips_only_what_contains_nothing(spark):
    net = reasoner.symmetrise(spark.createDataFrame([(0, 8, 1), (1, 24, 2), (3, 8, 1), (4, 64, 1), (5, 16, 2), (6, 128, 0)], "lhs long, rel int, rhs long"), C)
    every = net.select("lhs").distinct()
    kept = {r["lhs"] for r in reasoner.may_contain(net, every).collect()}
    found = {r["lhs"] for r in reasoner.closure(net, every, C).where("rel in (2, 4, 6)").collect()}
    assert found <= kept and 0 not in kept and 3 not in kept


def test_store_refuses_to_overwrite(spark, small, tmp_path):
    from meridian.plans.fixture import Fixture
    from meridian.plans.store import Store

    f = Fixture(spark, small)
    Store.write(spark, f.triples, f.network, f.geometries, f"file://{tmp_path}/g")
    with pytest.raises(Exception, match="(?i)exist"):
        Store.write(spark, f.triples, f.network, f.geometries, f"file://{tmp_path}/g")


def test_jaro_winkler():
    assert similarity.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and similarity.jaro_winkler("", "") == 1 and similarity.jaro_winkler("abc", "") == 0


FAST = ["proj_rename", "bgp_star", "bgp_cycle", "fn_jaro_winkler", "link_layer0", "link_layer1", "pip_polygon", "quan_containment_all", "quan_adjacency_all", "hybrid_range", "rcc8_compose_step", "rcc8_refine_step", "geo_join_touches", "rcc8_network", "src_geojson", "sink_vp_partitioned", "sparql_optional", "sparql_union", "sparql_nested", "sparql_offset", "query_file", "pip_two_layers"]


@pytest.mark.parametrize("name", FAST)
def test_queries(spark, small, name):
    assert not oracle.difference(spark, name, catalogue.queries()[name], catalogue.oracle_sql()[name], small)
