"""One query for each operator over the graph of the sales tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rcc8, similarity, terms
from ..operators import geometry as G
from ..operators import linking, network, reasoner, spatial
from ..sources import graph as io
from . import bgp
from .engine import Engine
from .fixture import BASE, SCHEMA, Fixture
from .sparql import RDF_TYPE, Pattern
from .store import Store, read_predicates

Build = Callable[[Fixture], DataFrame]
BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}
CALCULUS = rcc8.Calculus()
C = F.col

R = BASE
PREFIXES = f"PREFIX schema: <{SCHEMA}> PREFIX r: <{BASE}> PREFIX geo: <http://www.opengis.net/ont/geosparql#> PREFIX geof: <http://www.opengis.net/def/function/geosparql/> "

# Fixed values for the SQL, apart from the engine's own: the composition of two basic relations (128 DC, 64 EC, 32 PO, 16 TPP, 8 NTPP, 4 TPPi,
# 2 NTPPi, 1 EQ), row by row, column by column, as sums of relations.
BASIC_SETS = """
255 248 248 248 248 128 128 128
230 245 248 120 56 192 128 64
230 230 255 56 56 230 230 32
128 192 248 24 8 245 230 16
128 128 248 8 8 248 255 8
230 102 38 53 56 6 2 4
230 38 38 38 63 2 2 2
128 64 32 16 8 4 2 1
"""
BASIC = "VALUES " + ",".join(f"({128 >> i},{128 >> j},{c})" for i, row in enumerate(BASIC_SETS.strip().splitlines()) for j, c in enumerate(row.split()))

# The fixture graph in SQL. Every oracle begins with it.
WITH = f"""WITH RECURSIVE
nat AS (SELECT n_nationkey::BIGINT n, '<{R}nation_'||n_nationkey||'>' id, n_name nm, '<{R}region_'||n_regionkey||'>' parent, (10*(n_nationkey%5))::DOUBLE x0, (10*(n_nationkey//5))::DOUBLE y0 FROM nation),
reg AS (SELECT r_regionkey::BIGINT r, '<{R}region_'||r_regionkey||'>' id, r_name nm FROM region),
cus AS (SELECT c_custkey c, '<{R}customer_'||c_custkey||'>' id, c_name nm, '<{R}nation_'||c_nationkey||'>' parent, '<{R}segment_'||c_mktsegment||'>' seg, (10*(c_nationkey%5)+c_custkey%9)::DOUBLE+0.5::DOUBLE x, (10*(c_nationkey//5)+(c_custkey//9)%9)::DOUBLE+0.5::DOUBLE y FROM customer),
sup AS (SELECT s_suppkey s, '<{R}supplier_'||s_suppkey||'>' id, s_name nm, s_nationkey n, '<{R}nation_'||s_nationkey||'>' parent, CASE WHEN s_suppkey%7=0 THEN (s_nationkey+1)%25 ELSE s_nationkey END far FROM supplier),
spart AS (SELECT id, parent, 0 part_id, (10*(n%5)+1+s%7)::DOUBLE x, (10*(n//5)+1+(s//7)%7)::DOUBLE y FROM sup UNION ALL SELECT id, parent, 1, (10*(far%5)+1+(s+3)%7)::DOUBLE, (10*(far//5)+1+((s//7)+3)%7)::DOUBLE FROM sup),
pts AS (SELECT id, x, y FROM cus UNION ALL SELECT id, x+0.5::DOUBLE, y+0.5::DOUBLE FROM spart WHERE part_id=0),
typ(s,o) AS (SELECT id,'<{SCHEMA}Continent>' FROM reg UNION ALL SELECT id,'<{SCHEMA}Country>' FROM nat UNION ALL SELECT id,'<{SCHEMA}Person>' FROM cus UNION ALL SELECT id,'<{SCHEMA}Organization>' FROM sup),
lab(s,o) AS (SELECT id,'"'||nm||'"@en' FROM reg UNION ALL SELECT id,'"'||nm||'"@en' FROM nat UNION ALL SELECT id,'"'||nm||'"@en' FROM cus UNION ALL SELECT id,'"'||nm||'"@en' FROM sup UNION ALL SELECT id,'"'||nm||'"@de' FROM nat WHERE n%2=0),
cip(s,o) AS (SELECT id,parent FROM nat UNION ALL SELECT id,parent FROM cus UNION ALL SELECT id,parent FROM sup),
mem(s,o) AS (SELECT id,seg FROM cus), bir(s,o) AS (SELECT id,parent FROM cus),
geo(s,o) AS (SELECT id,'<geo:'||y||','||x||'>' FROM pts),
dis(s,o) AS (SELECT id,'"1999-12-31"' FROM nat WHERE n%10=9),
tri(s,p,o) AS (SELECT s,'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>',o FROM typ UNION ALL SELECT s,'<http://www.w3.org/2000/01/rdf-schema#label>',o FROM lab UNION ALL SELECT s,'<{SCHEMA}containedInPlace>',o FROM cip UNION ALL SELECT s,'<{SCHEMA}memberOf>',o FROM mem UNION ALL SELECT s,'<{SCHEMA}birthPlace>',o FROM bir UNION ALL SELECT s,'<{SCHEMA}geo>',o FROM geo UNION ALL SELECT s,'<{SCHEMA}dissolutionDate>',o FROM dis),
area AS (SELECT id, 0 part_id, 1::BIGINT cnt, (10*r)::DOUBLE xmin, 0::DOUBLE ymin, (10*r+10)::DOUBLE xmax, 50::DOUBLE ymax FROM reg UNION ALL SELECT id, 0, 1, x0, y0, x0+10, y0+10 FROM nat UNION ALL SELECT id, part_id, 2, x, y, x+1, y+1 FROM spart),
gm AS (SELECT * FROM area UNION ALL SELECT id, 0, 1, x, y, x, y FROM cus),
net(s,rel,o) AS (SELECT id,8,parent FROM cus UNION ALL SELECT id,24,parent FROM nat UNION ALL SELECT a.id,64,b.id FROM nat a JOIN nat b ON abs(a.x0-b.x0)<=10 AND abs(a.y0-b.y0)<=10 AND a.n<b.n UNION ALL SELECT a.id,64,b.id FROM reg a JOIN reg b ON b.r=a.r+1),
basic(r1,r2,c) AS ({BASIC}),
conv(m,c) AS (SELECT m::INTEGER, bit_or(c)::INTEGER FROM range(256) a(m), (VALUES (0,0),(128,128),(64,64),(32,32),(16,4),(8,2),(4,16),(2,8),(1,1)) v(r,c) WHERE r=0 OR m&r<>0 GROUP BY m),
sym(s,rel,o) AS (SELECT s,rel,o FROM net UNION SELECT o,conv.c,s FROM net JOIN conv ON conv.m=rel)
"""
# The sets of relations that composition and intersection make of the fixture's.
SETS = [0, 2, 4, 6, 8, 16, 24, 32, 36, 38, 48, 53, 55, 56, 61, 63, 64, 96, 100, 102, 112, 117, 119, 120, 125, 127, 128, 192, 224, 228, 230, 240, 245, 247, 248, 253]
IN_SETS = f"sets(m) AS (VALUES {','.join(f'({m})' for m in SETS)})"
COMP = f"{IN_SETS}, comp(r1,r2,c) AS (SELECT a.m, b.m, bit_or(c)::INTEGER FROM sets a, sets b, basic WHERE a.m&r1<>0 AND b.m&r2<>0 GROUP BY a.m, b.m)"
WITHIN_BOX = "q.xmin>=p.xmin AND q.ymin>=p.ymin AND q.xmax<=p.xmax AND q.ymax<=p.ymax AND (q.xmin<q.xmax OR (q.xmin>p.xmin AND q.xmin<p.xmax AND q.ymin>p.ymin AND q.ymin<p.ymax))"
TOUCH_BOX = "q.xmin<=p.xmax AND p.xmin<=q.xmax AND q.ymin<=p.ymax AND p.ymin<=q.ymax AND NOT (q.xmin<p.xmax AND p.xmin<q.xmax AND q.ymin<p.ymax AND p.ymin<q.ymax)"


def add(name: str, sql: str, *more: str):
    """Registers a query; ``sql`` is the SELECT after the common part, ``more`` further tables of it."""

    def keep(f: Build) -> Build:
        BUILDS[name], SQL[name] = f, WITH + "".join(f",\n{m}" for m in more) + "\n" + sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that executors share."""
    reasoner.ensure_checkpoints(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"


# Sources and sinks


@add("src_ntriples", "SELECT s AS subject, p AS predicate, o AS object FROM tri")
def _(f):
    path = scratch(f.spark)
    lines = f.triples.select(F.concat_ws("\t", "subject", "predicate", "object", F.lit(".")).alias("value"))
    lines.unionByName(f.spark.createDataFrame([("",), ("# a remark",)], "value string")).write.text(path)
    return io.read_ntriples(f.spark, path)


@add("src_geojson", "SELECT id AS region_id, nm AS name, 0 AS part_id, 5 AS n_points, x0+10 AS xmax, y0+10 AS ymax FROM nat UNION ALL SELECT s.id, nm, part_id, 5, x+1, y+1 FROM spart s JOIN sup USING (id)")
def _(f):
    path = scratch(f.spark)
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    one = f.nation_areas.select("id", "name", F.lit("Polygon").alias("type"), F.to_json(F.transform("rings", ring)).alias("coordinates"))
    parts = f.supplier_parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_id", "rings"))), lambda s: F.transform(s["rings"], ring)).alias("c"))
    many = f.supplier.join(parts, "id").select("id", "name", F.lit("MultiPolygon").alias("type"), F.to_json("c").alias("coordinates"))
    props = F.to_json(F.struct(C("id").alias("GID"), C("name").alias("NAME")))
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), C("type"), F.lit('","coordinates":'), C("coordinates"), F.lit("}}"))
    one.unionByName(many).select(text.alias("value")).write.text(path)
    r = G.with_envelope(io.read_geojson(f.spark, path, "GID", "NAME", lines=True))
    return r.select("region_id", "name", "part_id", F.size(F.element_at("rings", 1)).alias("n_points"), "xmax", "ymax")


@add("src_json_props", "SELECT DISTINCT 'R'||n AS \"GID_1\", nm AS \"NAME_1\", CASE WHEN n%2=0 THEN 'ALT_'||n END AS \"VARNAME_1\" FROM nat")
def _(f):
    path = scratch(f.spark)
    n = f.nation.select(F.concat(F.lit("R"), C("n").cast("string")).alias("GID_1"), C("name").alias("NAME_1"), F.when(C("n") % 2 == 0, F.concat(F.lit("ALT_"), C("n").cast("string"))).alias("VARNAME_1"))
    n.unionByName(n).select(F.to_json(F.struct(F.struct("*").alias("properties"))).alias("value")).write.text(path)
    return io.read_properties(f.spark, path, ["GID_1", "NAME_1", "VARNAME_1"])


@add("src_parquet", "SELECT id, nm AS name, x0, y0 FROM nat")
def _(f):
    path = scratch(f.spark)
    f.nation.select("id", "name", "x0", "y0").write.parquet(path)
    return f.spark.read.parquet(path)


@add("src_vp_scan", "SELECT s AS subject, o AS object FROM bir")
def _(f):
    path = scratch(f.spark)
    io.write_vertical(f.triples, path)
    return io.read_vertical(f.spark, path, "birthPlace").select("subject", "object")


@add("sink_vp_partitioned", "SELECT regexp_extract(p,'^<https?://([^/>]*)',1)||'/'||regexp_extract(p,'[#/]([^#/>]*)>$',1) AS vp, count(*) AS n FROM tri GROUP BY 1")
def _(f):
    path = scratch(f.spark)
    io.write_vertical(f.triples, path)
    return f.spark.read.parquet(path).groupBy(F.concat_ws("/", "host", "pred").alias("vp")).agg(F.count(F.lit(1)).alias("n"))


@add("sink_parquet_roundtrip", "SELECT id, part_id, cnt AS count, xmin, ymin, xmax, ymax FROM gm")
def _(f):
    path = scratch(f.spark)
    f.geometries.write.mode("overwrite").parquet(path)
    return f.spark.read.parquet(path).drop("rings")


NET_TEXT = "SELECT s AS lhs, rel, o AS rhs FROM net"


@add("src_rcc8_text", NET_TEXT)
def _(f):
    path = scratch(f.spark)
    line = F.concat_ws(" ", "lhs", F.when(C("rel") == 8, "5").when(C("rel") == 24, "4,5,").otherwise("2,"), "rhs", F.lit("1"))
    f.network.select(line.alias("value")).write.text(path)
    return io.read_network(f.spark, path)


@add("sink_rcc8_text", "SELECT s||' '||CASE rel WHEN 8 THEN '5,' WHEN 24 THEN '4,5,' ELSE '2,' END||' '||o||' 1' AS line FROM net")
def _(f):
    path = scratch(f.spark)
    io.write_network(f.network, path)
    return f.spark.read.text(path).select(C("value").alias("line"))


# Projection, filters, graph patterns


@add("proj_rename", "SELECT id AS subject, nm AS label FROM cus")
def _(f):
    return f.customer.select(C("id").alias("subject"), C("name").alias("label"))


@add("filter_id_in", "SELECT id, x, y FROM pts WHERE id IN (SELECT id FROM cus WHERE seg='<%ssegment_BUILDING>')" % R)
def _(f):
    some = f.customer.where(C("segment") == f"<{BASE}segment_BUILDING>").select("id")
    return f.points.join(some, "id", "left_semi")


@add("filter_label_en", "SELECT s AS subject, o AS label FROM lab WHERE right(o,3)='@en'")
def _(f):
    return f.predicate("label").where(terms.is_english(C("object"))).select("subject", C("object").alias("label"))


@add("filter_contains", "SELECT id, nm AS name FROM cus WHERE contains(nm,'99')")
def _(f):
    return f.customer.where(F.contains("name", F.lit("99"))).select("id", "name")


@add("link_by_type", f"SELECT s AS subject FROM typ WHERE o='<{SCHEMA}Country>'")
def _(f):
    return linking.of_type(f.predicate("type"), f"<{SCHEMA}Country>")


@add("link_not_dissolved", "SELECT id AS subject FROM nat WHERE id NOT IN (SELECT s FROM dis)")
def _(f):
    return linking.not_dissolved(f.nation.select(C("id").alias("subject")), f.predicate("dissolutionDate"))


def _triples(*rows: tuple[str, str, str]) -> list[Pattern]:
    return [Pattern(s, RDF_TYPE if p == "type" else f"<{SCHEMA}{p}>" if p != "label" else "<http://www.w3.org/2000/01/rdf-schema#label>", o) for s, p, o in rows]


@add("bgp_const_object", f"SELECT s AS c FROM mem WHERE o='<{R}segment_BUILDING>'")
def _(f):
    return bgp.plan(_triples(("?c", "memberOf", f"<{BASE}segment_BUILDING>")), f.scan)[0]


@add("bgp_const_subject", f"SELECT DISTINCT o AS n FROM bir WHERE s='<{R}customer_5>'")
def _(f):
    return bgp.plan(_triples((f"<{BASE}customer_5>", "birthPlace", "?n")), f.scan)[0]


@add("bgp_star", f"SELECT DISTINCT m.s AS c, b.o AS n, l.o AS l FROM mem m JOIN bir b USING (s) JOIN lab l USING (s) WHERE m.o='<{R}segment_MACHINERY>'")
def _(f):
    return bgp.plan(_triples(("?c", "memberOf", f"<{BASE}segment_MACHINERY>"), ("?c", "birthPlace", "?n"), ("?c", "label", "?l")), f.scan)[0].select("c", "n", "l")


@add("bgp_chain", "SELECT DISTINCT b.s AS c, b.o AS n, k.o AS r, l.o AS l FROM bir b JOIN cip k ON k.s=b.o JOIN lab l ON l.s=k.o")
def _(f):
    return bgp.plan(_triples(("?c", "birthPlace", "?n"), ("?n", "containedInPlace", "?r"), ("?r", "label", "?l")), f.scan)[0].select("c", "n", "r", "l")


@add("bgp_distinct", "SELECT DISTINCT o AS n FROM bir")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT DISTINCT ?n WHERE { ?c schema:birthPlace ?n }")


@add("bgp_project", f"SELECT b.o AS n FROM mem m JOIN bir b USING (s) WHERE m.o='<{R}segment_BUILDING>'")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?n WHERE { ?c schema:memberOf r:segment_BUILDING ; schema:birthPlace ?n . }")


@add("bgp_cycle", "SELECT DISTINCT b.s AS c, b.o AS n FROM bir b JOIN cip k ON k.s=b.s AND k.o=b.o")
def _(f):
    return bgp.plan(_triples(("?c", "birthPlace", "?n"), ("?c", "containedInPlace", "?n")), f.scan)[0].select("c", "n")


@add("bgp_order_limit", "SELECT s AS n FROM typ WHERE o='<%sCountry>' ORDER BY s DESC LIMIT 7" % SCHEMA)
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?n WHERE { ?n a schema:Country } ORDER BY DESC(?n) LIMIT 7")


NATION = "?n a schema:Country"


@add("sparql_optional", "SELECT nat.id AS n, dis.o AS d FROM nat LEFT JOIN dis ON dis.s=nat.id")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + f"SELECT ?n ?d WHERE {{ {NATION} . OPTIONAL {{ ?n schema:dissolutionDate ?d }} }}")


@add("sparql_union", f"SELECT id AS x, id AS c, NULL::VARCHAR AS n FROM cus WHERE seg='<{R}segment_BUILDING>' UNION ALL SELECT id, NULL, parent FROM sup")
def _(f):
    first, second = "?x schema:memberOf r:segment_BUILDING . ?x a schema:Person", "?x a schema:Organization . ?x schema:containedInPlace ?n"
    out = Engine(f.spark, f).query(PREFIXES + f"SELECT ?x ?n WHERE {{ {{ {first} }} UNION {{ {second} }} }}")
    return out.select("x", F.when(C("n").isNull(), C("x")).alias("c"), "n")


@add("sparql_nested", "SELECT c.id AS c, c.parent AS n, dis.o AS d FROM cus c LEFT JOIN dis ON dis.s=c.parent WHERE c.seg IN ('<%ssegment_BUILDING>','<%ssegment_MACHINERY>')" % (R, R))
def _(f):
    either = "{ ?c schema:memberOf r:segment_BUILDING } UNION { ?c schema:memberOf r:segment_MACHINERY }"
    return Engine(f.spark, f).query(PREFIXES + f"SELECT ?c ?n ?d WHERE {{ {{ ?c schema:birthPlace ?n }} {either} OPTIONAL {{ ?n schema:dissolutionDate ?d }} }}")


@add("sparql_offset", "SELECT s AS n FROM typ WHERE o='<%sCountry>' ORDER BY s OFFSET 5 LIMIT 9" % SCHEMA)
def _(f):
    return Engine(f.spark, f).query(PREFIXES + f"SELECT ?n WHERE {{ {NATION} }} ORDER BY ?n LIMIT 9 OFFSET 5")


@add("sparql_window_touches", "SELECT id AS n FROM nat WHERE x0<=20 AND x0+10>=10 AND y0<=20 AND y0+10>=10 AND NOT (x0<20 AND x0+10>10 AND y0<20 AND y0+10>10)")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + f'SELECT ?n WHERE {{ {NATION} . FILTER(geof:sfTouches(?n, "POLYGON((10 10,20 10,20 20,10 20,10 10))"^^geo:wktLiteral)) }}', "quan")


@add("query_file", f"SELECT 1 AS place, m.s AS x FROM mem m JOIN bir b USING (s) JOIN nat ON nat.id=b.o WHERE m.o='<{R}segment_BUILDING>' AND nat.parent='<{R}region_1>' UNION ALL SELECT 2, id FROM nat WHERE parent='<{R}region_3>'")
def _(f):
    path = scratch(f.spark)
    Store.write(f.spark, f.triples, f.network, f.geometries, path)
    names = f.spark.createDataFrame([("schema.org/birthPlace",), ("",), ("schema.org/memberOf",), ("www.w3.org/type",)], "value string")
    names.coalesce(1).write.text(f"{path}/predicates")
    store = Store(f.spark, f"{path}/triples", f"{path}/network", f"{path}/geometries", read_predicates(f.spark, f"{path}/predicates"))
    first = "SELECT ?x WHERE { ?x schema:memberOf r:segment_BUILDING . ?x schema:birthPlace ?n . ?n geo:sfWithin r:region_1 . }"
    second = f"SELECT ?x WHERE {{ ?x a schema:Country . ?x geo:sfWithin r:region_3 . }}"
    ran = Engine(f.spark, store).run_file("\n-----\n".join(PREFIXES + q for q in (first, second)))
    parts = [df.select(F.lit(i + 1).alias("place"), "x") for i, (_, df) in enumerate(ran)]
    return parts[0].unionByName(parts[1])


@add("src_feature_lines", "SELECT '\"NAME\": \"'||nm||'\",' AS line FROM nat")
def _(f):
    path = scratch(f.spark)
    text = F.concat(F.lit('"NAME": "'), C("name"), F.lit('",'))
    rows = f.nation.select(F.explode(F.array(text, F.lit("}"), F.lit("{"), F.lit('"OTHER": 1'))).alias("value"))
    rows.write.text(path)
    return io.feature_lines(f.spark, path, ["NAME"]).select(C("value").alias("line"))


# Scalar functions


@add("fn_geo_latlng", "SELECT id AS subject, y AS lat, x AS lng FROM pts")
def _(f):
    return f.predicate("geo").select("subject", terms.lat(C("object")).alias("lat"), terms.lng(C("object")).alias("lng"))


LABELS = """ll(s,label) AS (SELECT id, CASE n%5 WHEN 0 THEN '"'||nm||'"@en' WHEN 1 THEN '"'||nm||', old"@en' WHEN 2 THEN '"Province '||nm||'"@en' WHEN 3 THEN '"'||replace(nm,'O','U')||'"@en' ELSE '"Elsewhere"@en' END FROM nat UNION ALL SELECT id,'"'||nm||'"@de' FROM nat WHERE n%2=0)"""
SHORT = "regexp_replace(regexp_replace(regexp_replace(label,'^\"',''),'\"@.*$',''),',[^,]*$','')"


def labels(f: Fixture) -> DataFrame:
    """Labels that hit and miss: exact, with a suffix, with a type's word, misspelt, and of something else."""
    n, nm = C("n") % 5, C("name")
    text = F.when(n == 0, nm).when(n == 1, F.concat(nm, F.lit(", old"))).when(n == 2, F.concat(F.lit("Province "), nm)).when(n == 3, F.replace(nm, F.lit("O"), F.lit("U"))).otherwise(F.lit("Elsewhere"))
    en = f.nation.select(C("id").alias("subject"), F.concat(F.lit('"'), text, F.lit('"@en')).alias("object"))
    return en.unionByName(f.nation.where("n % 2 = 0").select(C("id").alias("subject"), F.concat(F.lit('"'), nm, F.lit('"@de')).alias("object")))


@add("fn_short_label", f"SELECT s AS subject, {SHORT} AS short FROM ll", LABELS)
def _(f):
    return labels(f).select("subject", terms.short_label(C("object")).alias("short"))


@add("fn_short_label_lower", f"SELECT s AS subject, lower({SHORT}) AS short FROM ll", LABELS)
def _(f):
    return labels(f).select("subject", terms.short_label_lower(C("object")).alias("short"))


@add("fn_name_in_label", "SELECT s AS subject, contains(label,nm) AS found FROM ll JOIN nat ON nat.id=s", LABELS)
def _(f):
    return labels(f).join(f.nation.select(C("id").alias("subject"), "name"), "subject").select("subject", terms.name_in_label(C("name"), C("object")).alias("found"))


@add("fn_jaro_winkler", f"SELECT s AS subject, round(jaro_winkler_similarity(nm,{SHORT}),6) AS sim FROM ll JOIN nat ON nat.id=s", LABELS)
def _(f):
    j = labels(f).join(f.nation.select(C("id").alias("subject"), "name"), "subject")
    return j.select("subject", F.round(similarity.similarity(C("name"), terms.short_label(C("object"))), 6).alias("sim"))


@add("fn_join_names", "SELECT id, lower(nm||CASE WHEN n%2=0 THEN '|Alt_'||n ELSE '' END) AS names FROM nat")
def _(f):
    return f.nation.select("id", terms.join_names(C("name"), F.when(C("n") % 2 == 0, F.concat(F.lit("Alt_"), C("n").cast("string")))).alias("names"))


@add("fn_strip_types", f"SELECT s AS subject, replace(replace(lower({SHORT}),'province',''),'old','') AS plain FROM ll", LABELS)
def _(f):
    return labels(f).select("subject", terms.strip_types(terms.short_label_lower(C("object")), ["Old", "Province"]).alias("plain"))


@add("fn_same_type", "SELECT s AS subject, contains(lower(label),'province') AS same FROM ll", LABELS)
def _(f):
    return labels(f).select("subject", terms.same_type(C("object"), F.lit("Province")).alias("same"))


@add("fn_vp_key", "SELECT p AS predicate, regexp_extract(p,'^<https?://([^/>]*)',1)||'/'||regexp_extract(p,'[#/]([^#/>]*)>$',1) AS vp FROM tri GROUP BY p")
def _(f):
    return f.triples.select("predicate").distinct().select("predicate", terms.vp_key(C("predicate")).alias("vp"))


ALT = "alt AS (SELECT id, label, lower(nm||CASE WHEN n%5=3 THEN '|natiun_'||n ELSE '' END) names FROM ll JOIN nat ON nat.id=s)"


@add("sim_alt_names", f"SELECT id, label, round(max(jaro_winkler_similarity(u.v, lower({SHORT}))),6) AS best FROM alt, unnest(string_split(names,'|')) u(v) GROUP BY id, label", LABELS, ALT)
def _(f):
    n = f.nation.select(C("id"), "name", F.when(C("n") % 5 == 3, F.concat(F.lit("natiun_"), C("n").cast("string"))).alias("var"))
    j = labels(f).select(C("subject").alias("id"), C("object").alias("label")).join(n, "id")
    return j.select("id", "label", F.round(similarity.best_name(terms.join_names(C("name"), C("var")), terms.short_label_lower(C("label"))), 6).alias("best"))


# Linking

PLACED = "placed AS (SELECT a.id s, 'R'||lpad(b.n::VARCHAR,2,'0') region_id, b.nm AS name, b.n rn FROM nat a JOIN nat b ON b.n IN (a.n, (a.n+1)%25))"
CANDS = f"cands AS (SELECT DISTINCT placed.s, region_id, name, label, rn FROM placed JOIN ll ON ll.s=placed.s AND right(label,3)='@en' JOIN typ ON typ.s=placed.s AND typ.o='<{SCHEMA}Country>' WHERE placed.s NOT IN (SELECT s FROM dis))"
L0 = f"l0 AS (SELECT *, jaro_winkler_similarity(name,{SHORT}) sim, contains(label,name) hit FROM cands)"
L0BEST = "m0 AS (SELECT s AS subject, region_id FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY hit DESC, sim DESC, s) k FROM l0) WHERE k=1 AND (hit OR sim>=0.8))"


def placed(f: Fixture) -> DataFrame:
    """Each nation lies in its own region's box and in the next one's."""
    a = f.nation.select(C("id").alias("subject"), F.explode(F.array(C("n"), (C("n") + 1) % 25)).alias("rn"))
    b = f.nation.select(C("n").alias("rn"), C("name"))
    return a.join(b, "rn").select("subject", F.concat(F.lit("R"), F.lpad(C("rn").cast("string"), 2, "0")).alias("region_id"), "name", "rn")


def link_candidates(f: Fixture) -> DataFrame:
    return linking.candidates(placed(f).drop("rn"), f.predicate("type"), f"<{SCHEMA}Country>", labels(f), f.predicate("dissolutionDate"))


def matches0(f: Fixture) -> DataFrame:
    return linking.layer0(linking.layer0_scores(link_candidates(f)))


@add("link_candidates", "SELECT s AS subject, region_id, name, label FROM cands", LABELS, PLACED, CANDS)
def _(f):
    return link_candidates(f)


@add("link_ranked", "SELECT s AS subject, region_id, round(sim,6) AS similarity, hit AS match, row_number() OVER (PARTITION BY region_id ORDER BY round(sim,6) DESC, s)::INTEGER AS place FROM l0", LABELS, PLACED, CANDS, L0)
def _(f):
    s = linking.layer0_scores(link_candidates(f)).withColumn("similarity", F.round("similarity", 6))
    w = Window.partitionBy("region_id").orderBy(F.desc("similarity"), "subject")
    return s.select("subject", "region_id", "similarity", "match", F.row_number().over(w).alias("place"))


@add("link_layer0", "SELECT subject, region_id FROM m0", LABELS, PLACED, CANDS, L0, L0BEST)
def _(f):
    return matches0(f)


KINDS = "tl(s,tl) AS (SELECT id, CASE WHEN n%3=0 THEN '\"Town of old\"@en' ELSE '\"Provinces of somewhere\"@en' END FROM nat)"
L1 = f"l1 AS (SELECT c.s, region_id, label, max(jaro_winkler_similarity(u.v, replace(replace(lower({SHORT}),'province',''),'town',''))) sim, bool_or(contains(lower(tl.tl),'province')) hit FROM cands c JOIN tl ON tl.s=c.s, unnest(string_split(lower(name||CASE WHEN rn%5=3 THEN '|Natiun_'||rn ELSE '' END),'|')) u(v) GROUP BY c.s, region_id, label)"
L1BEST = "m1 AS (SELECT s AS subject, region_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY hit DESC, sim DESC, region_id) j FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY hit DESC, sim DESC, s) k FROM l1) WHERE k=1) WHERE j=1 AND hit AND sim>=0.8)"


def matches1(f: Fixture) -> DataFrame:
    rn = F.substring("region_id", 2, 2).cast("int")
    c = link_candidates(f).withColumns({"varname": F.when(rn % 5 == 3, F.concat(F.lit("Natiun_"), rn.cast("string"))), "kind": F.lit("Province")})
    kinds = f.nation.select(C("id").alias("subject"), F.when(C("n") % 3 == 0, '"Town of old"@en').otherwise('"Provinces of somewhere"@en').alias("type_label"))
    return linking.layer1(linking.layer1_scores(c, kinds, ["Town", "Province"]))


@add("link_layer1", "SELECT subject, region_id FROM m1", LABELS, PLACED, CANDS, KINDS, L1, L1BEST)
def _(f):
    return matches1(f)


@add("union_layers", "SELECT subject, region_id FROM m0 UNION ALL SELECT subject, region_id FROM m1", LABELS, PLACED, CANDS, L0, L0BEST, KINDS, L1, L1BEST)
def _(f):
    return matches0(f).unionByName(matches1(f))


# Geometry


@add("g_point", "SELECT id, x, y FROM pts")
def _(f):
    p = G.with_envelope(f.points.select("id", G.point(C("x"), C("y")).alias("rings")))
    return p.select("id", C("xmin").alias("x"), C("ymax").alias("y"))


WKT_BOX = "'POLYGON(('||x0||' '||y0||','||(x0+10)||' '||y0||','||(x0+10)||' '||(y0+10)||','||x0||' '||(y0+10)||','||x0||' '||y0||'))'"


@add("g_as_text", f"SELECT id, {WKT_BOX} AS wkt FROM nat UNION ALL SELECT id, 'POINT('||x||' '||y||')' FROM pts")
def _(f):
    return f.nation_areas.select("id", "rings").unionByName(f.points.select("id", G.point(C("x"), C("y")).alias("rings"))).select("id", G.as_text(C("rings")).alias("wkt"))


@add("g_from_wkt", "SELECT id, 5 AS n_points, x0 AS xmin, y0+10 AS ymax FROM nat")
def _(f):
    r = f.nation_areas.select("id", G.from_wkt(G.as_text(C("rings"))).alias("rings"))
    return G.with_envelope(r).select("id", F.size(F.element_at("rings", 1)).alias("n_points"), "xmin", "ymax")


@add("geom_counts", "SELECT id, count(*) AS count FROM spart GROUP BY id")
def _(f):
    return network.counted(f.supplier_parts.select("id", "part_id")).select("id", "count").distinct()


@add("mbb", "SELECT id, min(x) AS xmin, min(y) AS ymin, max(x)+1 AS xmax, max(y)+1 AS ymax FROM spart GROUP BY id")
def _(f):
    return G.with_envelope(f.supplier_parts).groupBy("id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@add("centroid", "SELECT id, avg(x)+0.5 AS x, avg(y)+0.5 AS y FROM spart GROUP BY id")
def _(f):
    return G.centroid(f.supplier_parts.select("id", "rings"), "id").select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _layers(f: Fixture) -> DataFrame:
    return matches0(f)


def _named_regions(f: Fixture) -> DataFrame:
    return f.nation.select(F.concat(F.lit("R"), F.lpad(C("n").cast("string"), 2, "0")).alias("region_id"), F.lit(0).alias("part_id"), G.box(C("x0"), C("y0"), C("x0") + 10, C("y0") + 10).alias("rings"))


@add("geoms_substitute", "SELECT coalesce(m.subject, 'R'||lpad(n::VARCHAR,2,'0')) AS id, x0 AS xmin FROM nat LEFT JOIN m0 m ON m.region_id='R'||lpad(n::VARCHAR,2,'0')", LABELS, PLACED, CANDS, L0, L0BEST)
def _(f):
    m = _layers(f).select(C("subject").alias("to_"), "region_id")
    r = _named_regions(f).join(m, "region_id", "left").select(F.coalesce("to_", "region_id").alias("id"), "rings")
    return G.with_envelope(r).select("id", "xmin")


@add("geoms_build", "SELECT id, count(*) OVER (PARTITION BY id) AS count, xmin FROM (SELECT coalesce(m.subject, 'R'||lpad(n::VARCHAR,2,'0')) AS id, x0 AS xmin FROM nat LEFT JOIN m0 m ON m.region_id='R'||lpad(n::VARCHAR,2,'0') UNION ALL SELECT id, x FROM pts WHERE id NOT IN (SELECT subject FROM m0))", LABELS, PLACED, CANDS, L0, L0BEST)
def _(f):
    points = f.points.select(C("id").alias("subject"), G.point(C("x"), C("y")).alias("rings"))
    return G.with_envelope(network.build_geometries(_named_regions(f), points, _layers(f))).select("id", "count", "xmin")


# Spatial joins


def _subjects(f: Fixture) -> DataFrame:
    return f.points.withColumnRenamed("id", "subject")


@add("pip_polygon", "SELECT p.id AS subject, nat.id AS region_id FROM pts p JOIN nat ON p.x>x0 AND p.x<x0+10 AND p.y>y0 AND p.y<y0+10")
def _(f):
    return spatial.points_in_polygons(_subjects(f), G.with_envelope(f.nation_areas)).select(C("l_subject").alias("subject"), C("r_id").alias("region_id"))


@add("pip_mbb", "SELECT p.id AS subject, b.id AS region_id FROM pts p JOIN (SELECT id, min(x) xmin, min(y) ymin, max(x)+1 xmax, max(y)+1 ymax FROM spart GROUP BY id) b ON p.x>xmin AND p.x<xmax AND p.y>ymin AND p.y<ymax")
def _(f):
    boxes = G.with_envelope(f.supplier_parts).groupBy("id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    return spatial.points_in_boxes(_subjects(f), boxes).select(C("l_subject").alias("subject"), C("r_id").alias("region_id"))


@add("pip_unplaced", "SELECT p.id AS subject FROM pts p WHERE NOT EXISTS (SELECT 1 FROM spart s WHERE p.x>s.x AND p.x<s.x+1 AND p.y>s.y AND p.y<s.y+1)")
def _(f):
    found = spatial.points_in_polygons(_subjects(f), G.with_envelope(f.supplier_parts)).select(C("l_subject").alias("subject"))
    return f.points.select(C("id").alias("subject")).join(found, "subject", "left_anti")


@add("pip_two_layers", "SELECT p.id AS subject, s.id AS region_id, 1 AS layer FROM pts p JOIN spart s ON p.x>s.x AND p.x<s.x+1 AND p.y>s.y AND p.y<s.y+1 UNION ALL SELECT p.id, nat.id, 0 FROM pts p JOIN nat ON p.x>x0 AND p.x<x0+10 AND p.y>y0 AND p.y<y0+10 WHERE NOT EXISTS (SELECT 1 FROM spart s WHERE p.x>s.x AND p.x<s.x+1 AND p.y>s.y AND p.y<s.y+1)")
def _(f):
    # The fine layer first; what it leaves is written beside the result and placed in the coarse one.
    fine, path = spatial.points_in_polygons(_subjects(f), G.with_envelope(f.supplier_parts)), scratch(f.spark)
    _subjects(f).join(fine.select(C("l_subject").alias("subject")), "subject", "left_anti").write.parquet(path)
    coarse = spatial.points_in_polygons(f.spark.read.parquet(path), G.with_envelope(f.nation_areas))
    pick = lambda df, layer: df.select(C("l_subject").alias("subject"), C("r_id").alias("region_id"), F.lit(layer).alias("layer"))
    return pick(fine, 1).unionByName(pick(coarse, 0))


@add("anti_matched_points", "SELECT s AS subject, o AS object FROM cip WHERE s NOT IN (SELECT subject FROM m0)", LABELS, PLACED, CANDS, L0, L0BEST)
def _(f):
    return network.without(f.predicate("containedInPlace").select("subject", "object"), matches0(f))


def _regions(f: Fixture) -> DataFrame:
    return G.with_envelope(f.region_areas.unionByName(f.nation_areas))


@add("ec_window", "SELECT id FROM area WHERE part_id=0 AND cnt=1 AND xmax>=5 AND xmin<=20 AND ymax>=5 AND ymin<=12")
def _(f):
    return spatial.in_window(_regions(f), 5, 12, 20, 5).select("id")


@add("ec_pairs", f"SELECT p.id AS region_id1, q.id AS region_id2 FROM nat a JOIN area p ON p.id=a.id JOIN area q ON q.id<>p.id AND {TOUCH_BOX} JOIN nat b ON b.id=q.id")
def _(f):
    return spatial.touching(G.with_envelope(f.nation_areas))


@add("dc_pairs", f"SELECT p.id AS id1, q.id AS id2 FROM nat a JOIN area p ON p.id=a.id JOIN area q ON p.id<q.id AND NOT ({TOUCH_BOX}) JOIN nat b ON b.id=q.id")
def _(f):
    return spatial.disconnected(f.nation_areas.select("id"), spatial.touching(G.with_envelope(f.nation_areas)))


@add("knn_centroid", "SELECT subject, id, distance FROM (SELECT c.id AS subject, b.id AS id, sqrt((c.x-b.x)**2+(c.y-b.y)**2) AS distance, row_number() OVER (PARTITION BY c.id ORDER BY sqrt((c.x-b.x)**2+(c.y-b.y)**2), b.id) k FROM cus c, (SELECT id, avg(x)+0.5 x, avg(y)+0.5 y FROM spart GROUP BY id) b) WHERE k=1")
def _(f):
    sites = G.centroid(f.supplier_parts.select("id", "rings"), "id").select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
    return spatial.nearest(f.customer.select(C("id").alias("subject"), "x", "y"), sites)


PARENTS = "par AS (SELECT id FROM nat UNION ALL SELECT id FROM reg)"


def _parents(f: Fixture) -> DataFrame:
    return f.nation.select("id").unionByName(f.region.select("id"))


@add("quan_containment", f"SELECT p.id AS parent, q.id AS child FROM area p JOIN par ON par.id=p.id JOIN area q ON q.id<>p.id AND {WITHIN_BOX} JOIN sup ON sup.id=q.id GROUP BY p.id, q.id HAVING count(DISTINCT q.part_id)=max(q.cnt)", PARENTS)
def _(f):
    return spatial.containment(f.geometries, _parents(f), f.supplier.select("id"))


@add("quan_containment_all", f"SELECT p.id AS parent, q.id AS child FROM gm p JOIN par ON par.id=p.id JOIN gm q ON q.id<>p.id AND {WITHIN_BOX} GROUP BY p.id, q.id HAVING count(DISTINCT q.part_id)=max(q.cnt) UNION ALL SELECT id, id FROM par", PARENTS)
def _(f):
    return spatial.containment(f.geometries, _parents(f))


@add("quan_adjacency", f"SELECT DISTINCT p.id AS parent, q.id AS child FROM area p JOIN par ON par.id=p.id JOIN area q ON q.id<>p.id AND {TOUCH_BOX} JOIN nat ON nat.id=q.id", PARENTS)
def _(f):
    return spatial.adjacency(f.geometries, _parents(f), f.nation.select("id"))


@add("quan_adjacency_all", f"SELECT DISTINCT p.id AS parent, q.id AS child FROM gm p JOIN par ON par.id=p.id JOIN gm q ON q.id<>p.id AND {TOUCH_BOX}", PARENTS)
def _(f):
    return spatial.adjacency(f.geometries, _parents(f))


WINDOW = "POLYGON((-1 -1,21.25 -1,21.25 21.25,-1 21.25,-1 -1))"
IN_WINDOW = "win AS (SELECT id AS child FROM gm GROUP BY id HAVING bool_and(xmin>=-1 AND ymin>=-1 AND xmax<=21.25 AND ymax<=21.25))"


@add("quan_range", "SELECT child FROM win", IN_WINDOW)
def _(f):
    return spatial.within_window(f.geometries, G.parse_wkt(WINDOW))


@add("hybrid_range", "SELECT child AS p FROM (SELECT child FROM win UNION SELECT c.id FROM cus c WHERE c.parent IN (SELECT child FROM win)) WHERE child IN (SELECT id FROM cus)", IN_WINDOW)
def _(f):
    return Engine(f.spark, f).query(PREFIXES + f'SELECT ?p WHERE {{ ?p a schema:Person . FILTER(geof:sfWithin(?p, "{WINDOW}"^^geo:wktLiteral)) }}', "hybrid")


@add("quan_query", f"SELECT m.s AS c, b.o AS n FROM mem m JOIN bir b USING (s) JOIN nat ON nat.id=b.o WHERE m.o='<{R}segment_BUILDING>' AND nat.parent='<{R}region_1>'")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?c ?n WHERE { ?c schema:memberOf r:segment_BUILDING . ?c schema:birthPlace ?n . ?n geo:sfWithin r:region_1 . }", "quan")


# Reasoning


@add("rcc8_calculus", "SELECT r1, r2, c AS comp FROM basic")
def _(f):
    # Read back from a calculus file: relations, converses, a line for each cell.
    cells = [f"{i + 1} {j + 1} {','.join(map(str, rcc8.numbers(c)))}" for i, row in enumerate(CALCULUS.basic) for j, c in enumerate(row)]
    text = "\n".join([" ".join(rcc8.NAMES), " ".join(map(str, rcc8.CONVERSES)), *cells])
    return rcc8.Calculus.parse(text).compositions(f.spark, [1 << i for i in range(8)])


@add("rcc8_codec", "SELECT m::INTEGER AS mask, coalesce(string_agg(CASE WHEN (m>>(8-r))&1=1 THEN r||',' END, '' ORDER BY r),'') AS rels FROM range(256) a(m), range(1,9) b(r) GROUP BY m")
def _(f):
    masks = f.spark.range(256).select(C("id").cast("int").alias("m")).select(rcc8.format_set(C("m")).alias("rels"))
    return masks.select(rcc8.parse_set(C("rels")).alias("mask"), "rels")


@add("rcc8_converse", "SELECT m AS mask, bit_or(CASE WHEN (m>>(8-r))&1=1 THEN 1<<(8-to_) ELSE 0 END)::INTEGER AS converse FROM conv, (VALUES (1,1),(2,2),(3,3),(4,6),(5,7),(6,4),(7,5),(8,8)) v(r,to_) GROUP BY m")
def _(f):
    return f.spark.range(256).select(C("id").cast("int").alias("mask")).select("mask", CALCULUS.converses_of(C("mask")).alias("converse"))


@add("rcc8_comp_table", "SELECT r1, r2, c AS comp FROM comp", COMP)
def _(f):
    return CALCULUS.compositions(f.spark, SETS)


@add("rcc8_intersect", "SELECT a.m AS r1, b.m AS r2, (a.m&b.m)::INTEGER AS both FROM sets a, sets b", IN_SETS)
def _(f):
    s = f.spark.createDataFrame([(m,) for m in SETS], "m int")  # 36 sets
    return s.select(C("m").alias("r1")).crossJoin(F.broadcast(s.select(C("m").alias("r2")))).select("r1", "r2", C("r1").bitwiseAND(C("r2")).alias("both"))


@add("rcc8_size", "SELECT m::INTEGER AS mask, bit_count(m::INTEGER)::INTEGER AS size FROM range(256) a(m)")
def _(f):
    return f.spark.range(256).select(C("id").cast("int").alias("mask")).select("mask", F.bit_count("mask").alias("size"))


@add("rcc8_possible_rels", "SELECT m FROM sets", IN_SETS)
def _(f):
    net = reasoner.symmetrise(f.network, CALCULUS)
    start = {r[0] for r in net.select("rel").distinct().collect()}
    return f.spark.createDataFrame([(m,) for m in sorted(CALCULUS.reachable(start))], "m int")


@add("rcc8_symmetrise", "SELECT s AS lhs, rel, o AS rhs FROM sym")
def _(f):
    return reasoner.symmetrise(f.network, CALCULUS)


SOURCES = [f"<{BASE}region_1>", f"<{BASE}nation_7>", f"<{BASE}customer_5>"]
SRC = "src(s) AS (VALUES " + ",".join(f"('{s}')" for s in SOURCES) + ")"
FIRST = "SELECT s, rel, o FROM sym WHERE s IN (SELECT s FROM src)"
FIX = f"""e(k,s,rel,o) AS (SELECT 1, s, rel, o FROM ({FIRST}) UNION ALL SELECT k+1, s, bit_and(rel), o FROM (SELECT k, s, rel, o FROM e UNION ALL SELECT e.k, e.s, comp.c, sym.o FROM e JOIN sym ON e.o=sym.s JOIN comp ON comp.r1=e.rel AND comp.r2=sym.rel WHERE e.s<>sym.o AND comp.c<>255) WHERE k<12 GROUP BY k, s, o)"""


def _sources(f: Fixture) -> DataFrame:
    return f.spark.createDataFrame([(s,) for s in SOURCES], "lhs string")


@add("rcc8_sources", FIRST.replace("SELECT s, rel, o", "SELECT s AS lhs, rel, o AS rhs"), SRC)
def _(f):
    return reasoner.sources_of(reasoner.symmetrise(f.network, CALCULUS), _sources(f))


STEP = "st(s,rel,o) AS (SELECT a.s, comp.c, b.o FROM sym a JOIN sym b ON a.o=b.s JOIN comp ON comp.r1=a.rel AND comp.r2=b.rel WHERE a.s IN (SELECT s FROM src) AND a.s<>b.o AND comp.c<>255)"


def _step(f: Fixture) -> tuple[DataFrame, DataFrame]:
    net = reasoner.symmetrise(f.network, CALCULUS)
    first = reasoner.sources_of(net, _sources(f))
    return first, reasoner.compose_step(first, net, CALCULUS.compositions(f.spark, SETS))


@add("rcc8_compose_step", "SELECT s AS lhs, rel, o AS rhs FROM st", SRC, COMP, STEP)
def _(f):
    return _step(f)[1]


@add("rcc8_refine_step", "SELECT s AS lhs, o AS rhs, bit_and(rel)::INTEGER AS rel, max(was)::INTEGER AS was FROM (SELECT s, o, rel, NULL::INTEGER AS was FROM st UNION ALL SELECT s, o, rel, rel FROM sym WHERE s IN (SELECT s FROM src)) GROUP BY s, o", SRC, COMP, STEP)
def _(f):
    return reasoner.refine_step(*_step(f))


@add("rcc8_closure", "SELECT s AS lhs, rel::INTEGER AS rel, o AS rhs FROM e WHERE k=12", SRC, COMP, FIX)
def _(f):
    return reasoner.closure(reasoner.symmetrise(f.network, CALCULUS), _sources(f), CALCULUS)


ONE = lambda s: f"src(s) AS (VALUES ('<{R}{s}>'))"


@add("rcc8_within", "SELECT s AS parent, o AS child FROM e WHERE k=12 AND rel&249=0", ONE("region_2"), COMP, FIX)
def _(f):
    one = f.spark.createDataFrame([(f"<{BASE}region_2>",)], "id string")
    return Engine(f.spark, f).reasoned(one, rcc8.WITHIN)


@add("rcc8_touches", "SELECT s AS parent, o AS child FROM e WHERE k=12 AND rel=64", ONE("nation_12"), COMP, FIX)
def _(f):
    one = f.spark.createDataFrame([(f"<{BASE}nation_12>",)], "id string")
    return Engine(f.spark, f).reasoned(one, rcc8.TOUCHES)


@add("rcc8_lax_filter", "SELECT s AS parent, o AS child FROM e WHERE k=12 AND rel&6<>0 AND bit_count(rel::INTEGER)<=2", ONE("region_2"), COMP, FIX)
def _(f):
    one = f.spark.createDataFrame([(f"<{BASE}region_2>",)], "id string")
    return Engine(f.spark, f, lax=True).reasoned(one, rcc8.WITHIN)


BAD = "bad(s,rel,o) AS (VALUES (0,8,1),(1,2,0),(1,8,2),(2,2,1),(2,8,0),(0,2,2))"


@add("rcc8_inconsistent", "SELECT s::BIGINT AS lhs, o::BIGINT AS rhs FROM (SELECT s, o, rel FROM bad UNION ALL SELECT a.s, b.o, comp.c FROM bad a JOIN bad b ON a.o=b.s AND a.s<>b.o JOIN comp ON comp.r1=a.rel AND comp.r2=b.rel WHERE comp.c<>255) GROUP BY s, o HAVING bit_and(rel)=0", BAD, COMP)
def _(f):
    net = reasoner.symmetrise(f.spark.createDataFrame([(0, 8, 1), (1, 8, 2), (2, 8, 0)], "lhs long, rel int, rhs long"), CALCULUS)
    step = reasoner.compose_step(net, net, CALCULUS.compositions(f.spark, SETS))
    return reasoner.refine_step(net, step).where("rel = 0").select("lhs", "rhs")


@add("qual_query", f"SELECT m.s AS c FROM mem m JOIN bir b USING (s) JOIN nat ON nat.id=b.o WHERE m.o='<{R}segment_BUILDING>' AND nat.parent='<{R}region_1>'")
def _(f):
    return flagship(f)


def flagship(f: Fixture) -> DataFrame:
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?c WHERE { ?c schema:memberOf r:segment_BUILDING . ?c schema:birthPlace ?n . ?n geo:sfWithin r:region_1 . }")


@add("geo_const_within", f"SELECT id AS n FROM nat WHERE parent='<{R}region_3>'")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?n WHERE { ?n a schema:Country . ?n geo:sfWithin r:region_3 . }")


@add("geo_const_touches", f"SELECT q.id AS n FROM area p JOIN area q ON q.id<>p.id AND {TOUCH_BOX} JOIN nat ON nat.id=q.id WHERE p.id='<{R}nation_7>'")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?n WHERE { ?n a schema:Country . ?n geo:sfTouches r:nation_7 . }")


@add("geo_join_within", "SELECT id AS n, parent AS r FROM nat")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?n ?r WHERE { ?n a schema:Country . ?r a schema:Continent . ?n geo:sfWithin ?r . }")


@add("geo_join_touches", f"SELECT q.id AS n, p.id AS m FROM area p JOIN nat a ON a.id=p.id JOIN area q ON q.id<>p.id AND {TOUCH_BOX} JOIN nat b ON b.id=q.id")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?n ?m WHERE { ?n a schema:Country . ?m a schema:Country . ?n geo:sfTouches ?m . }")


@add("geo_contains", "SELECT parent AS r, id AS n FROM nat")
def _(f):
    return Engine(f.spark, f).query(PREFIXES + "SELECT ?r ?n WHERE { ?n a schema:Country . ?r a schema:Continent . ?r geo:sfContains ?n . }")


# Network and dictionary

EDGES = "SELECT subject, rel, object FROM "
GID = "gid AS (SELECT 'R'||lpad((n//2*2)::VARCHAR,2,'0')||'.'||n||'_1' region_id FROM nat)"
G0 = "g0 AS (SELECT coalesce(m.subject,x.subject) subject, rel, coalesce(k.subject,x.object) object FROM (SELECT region_id AS subject, 24 AS rel, left(region_id,3) AS object FROM gid) x LEFT JOIN m0 m ON m.region_id=x.subject LEFT JOIN m0 k ON k.region_id=x.object)"
PL = "pl AS (SELECT id AS subject, 'R'||lpad((floor(x/10)+5*floor(y/10))::INTEGER::VARCHAR,2,'0') AS region_id FROM pts)"
Q0 = "q0 AS (SELECT pl.subject, 8 AS rel, coalesce(m.subject,pl.region_id) AS object FROM pl LEFT JOIN m0 m ON m.region_id=pl.region_id WHERE pl.subject NOT IN (SELECT subject FROM m0))"
C0 = "c0 AS (SELECT s AS subject, 8 AS rel, min(o) AS object FROM cip GROUP BY s)"
HOLD = "hold AS (SELECT object FROM g0 WHERE subject IN (SELECT subject FROM m0) UNION SELECT object FROM c0 WHERE subject IN (SELECT subject FROM m0))"
Q1 = "q1 AS (SELECT * FROM q0 WHERE subject NOT IN (SELECT object FROM hold))"
C1 = "c1 AS (SELECT * FROM c0 WHERE subject NOT IN (SELECT object FROM hold))"
RES = "res AS (SELECT subject, rel, object FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pr, object, rel) k FROM (SELECT *, 0 pr FROM g0 UNION ALL SELECT *, 1 FROM q1 UNION ALL SELECT *, 2 FROM c1)) WHERE k=1)"
ECN = f"ecn AS (SELECT coalesce(m.subject,a) AS subject, 64 AS rel, coalesce(k.subject,b) AS object FROM (SELECT DISTINCT least('R'||lpad(a.n::VARCHAR,2,'0'),'R'||lpad(b.n::VARCHAR,2,'0')) a, greatest('R'||lpad(a.n::VARCHAR,2,'0'),'R'||lpad(b.n::VARCHAR,2,'0')) b FROM nat a JOIN nat b ON a.n<>b.n AND abs(a.x0-b.x0)<=10 AND abs(a.y0-b.y0)<=10) LEFT JOIN m0 m ON m.region_id=a LEFT JOIN m0 k ON k.region_id=b)"
M0 = (LABELS, PLACED, CANDS, L0, L0BEST)
NET = (*M0, GID, G0, PL, Q0, C0, HOLD, Q1, C1, RES, ECN)


def _code(n: Column) -> Column:
    return F.concat(F.lit("R"), F.lpad(n.cast("string"), 2, "0"))


def _gid(f: Fixture) -> DataFrame:
    return f.nation.select(F.concat(_code(F.floor(C("n") / 2) * 2), F.lit("."), C("n").cast("string"), F.lit("_1")).alias("region_id"))


def _pl(f: Fixture) -> DataFrame:
    areas = G.with_envelope(_named_regions(f))
    return spatial.points_in_polygons(_subjects(f), areas).select(C("l_subject").alias("subject"), C("r_region_id").alias("region_id"))


def _touching(f: Fixture) -> DataFrame:
    return spatial.touching(G.with_envelope(_named_regions(f).withColumnRenamed("region_id", "id")))


def _contained(f: Fixture) -> DataFrame:
    return f.predicate("containedInPlace").select("subject", "object")


@add("net_from_pip", "SELECT subject, 8 AS rel, region_id AS object FROM pl", PL)
def _(f):
    return network.from_points(_pl(f))


@add("net_from_contained", EDGES + "c0", C0)
def _(f):
    return network.from_contained(_contained(f).unionByName(_contained(f).withColumn("object", F.concat("object", F.lit("z")))))


@add("net_from_gid", "SELECT region_id AS subject, 24 AS rel, left(region_id,3) AS object FROM gid", GID)
def _(f):
    return network.from_region_ids(_gid(f))


@add("net_ec_dedupe", "SELECT DISTINCT least(a.id,b.id) AS subject, 64 AS rel, greatest(a.id,b.id) AS object FROM nat a JOIN nat b ON a.n<>b.n AND abs(a.x0-b.x0)<=10 AND abs(a.y0-b.y0)<=10")
def _(f):
    return network.from_touching(spatial.touching(G.with_envelope(f.nation_areas)))


@add("net_substitute", EDGES + "g0", *M0, GID, G0)
def _(f):
    m = matches0(f)
    return network.substitute(network.substitute(network.from_region_ids(_gid(f)), "subject", m), "object", m)


@add("net_clean_containers", EDGES + "c1", *M0, GID, G0, C0, HOLD, C1)
def _(f):
    m = matches0(f)
    gadm = network.substitute(network.substitute(network.from_region_ids(_gid(f)), "subject", m), "object", m)
    qual = network.from_contained(_contained(f))
    return network.clean_containers(qual, gadm, qual, m)


@add("net_resolve_priority", EDGES + "res", *NET[:-1])
def _(f):
    m = matches0(f)
    gadm = network.substitute(network.substitute(network.from_region_ids(_gid(f)), "subject", m), "object", m)
    quan = network.substitute(network.from_points(network.without(_pl(f), m)), "object", m)
    qual = network.from_contained(_contained(f))
    return network.resolve(gadm, network.clean_containers(quan, gadm, qual, m), network.clean_containers(qual, gadm, qual, m))


@add("rcc8_network", EDGES + "res UNION ALL " + EDGES + "ecn", *NET)
def _(f):
    return network.build_network(_pl(f), _contained(f), _gid(f), _touching(f), matches0(f))


@add("dict_build", "SELECT DISTINCT id, 1::BIGINT AS uses FROM (SELECT s AS id FROM net UNION SELECT o FROM net)")
def _(f):
    d = network.build_dictionary(f.network, "lhs", "rhs")
    return d.select("id", F.count(F.lit(1)).over(Window.partitionBy("encodedId")).alias("uses"))


def _coded(f: Fixture) -> tuple[DataFrame, DataFrame]:
    reasoner.ensure_checkpoints(f.spark)
    d = network.build_dictionary(f.network, "lhs", "rhs").checkpoint()
    return network.encode(f.network.select(C("lhs").alias("subject"), "rel", C("rhs").alias("object")), d), d


@add("dict_encode", NET_TEXT)
def _(f):
    coded, d = _coded(f)
    return network.decode(coded, d, ["lhs", "rhs"]).select("lhs", "rel", "rhs")


@add("dict_decode", "SELECT parent, child FROM (SELECT o AS parent, s AS child FROM net WHERE rel=8 UNION ALL SELECT o, s FROM net WHERE rel=24)")
def _(f):
    coded, d = _coded(f)
    pairs = coded.where(rcc8.entails(C("rel"), rcc8.CONTAINS)).select(C("rhs").alias("parent"), C("lhs").alias("child"))
    return network.decode(pairs, d, ["parent", "child"]).select("parent", "child")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, b=b: b(Fixture(spark, sf_dir))) for k, b in BUILDS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
