"""Readers and writers: N-Triples, one dataset partitioned by predicate, GeoJSON, relation networks as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.rcc8 import format_set, parse_set

GEOJSON = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``subject, predicate, object`` of tab-separated lines that begin with ``<``; others are passed over."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("<")))
    part = F.split("value", "\t")
    return lines.select(*[F.get(part, i).alias(c) for i, c in enumerate(("subject", "predicate", "object"))])


def write_vertical(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One dataset, partitioned by host and local name: one job for all predicates. The IRI stays as a column."""
    key = F.split(terms.vp_key(F.col("predicate")), "/")
    rows = triples.withColumns({"host": F.get(key, 0), "pred": F.get(key, 1)})
    rows.repartition("host", "pred", F.pmod(F.xxhash64("subject"), F.lit(32))).write.mode(mode).partitionBy("host", "pred").parquet(path)


def read_vertical(spark: SparkSession, path: str, local: str | None = None, predicate: str | None = None) -> DataFrame:
    """``subject, predicate, object`` of one predicate: a filter on the partition, so nothing else is read."""
    df = spark.read.parquet(path)
    if local is not None:
        df = df.where(F.col("pred") == local)
    if predicate is not None:
        df = df.where(F.col("predicate") == predicate)
    return df.select("subject", "predicate", "object")


def feature_lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``value``: the lines of a pretty-printed collection that hold one of ``names`` as a property, without the collection's own first and last lines."""
    lines = spark.read.text(path)
    wrap = F.trim("value").isin("{", "}")
    return lines.where(~wrap & reduce(lambda a, b: a | b, [F.contains("value", F.lit(f'"{n}"')) for n in names]))


def read_geojson(spark: SparkSession, path: str, id_col: str, name_col: str, lines: bool = False) -> DataFrame:
    """``region_id, name, part_id, rings``: a row for each polygon of a feature or collection: a file each, or a line each.

    Files of lines are split among tasks; other files are read whole.

    A feature whose geometry is neither a polygon nor several raises when it is read.
    """
    whole = spark.read.schema(f"{GEOJSON}, features array<{_struct()}>").option("multiLine", str(not lines).lower()).json(path)
    one = F.array(F.struct("properties", "geometry"))
    many = F.transform("features", lambda f: F.struct(f["properties"].alias("properties"), f["geometry"].alias("geometry")))
    rows = whole.select(F.explode(F.when(F.col("features").isNotNull(), many).otherwise(one)).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>")))
    parts = parts.when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    parts = parts.otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("null")))))
    rings = F.transform("part", lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    rows = rows.select(F.col("f.properties")[id_col].alias("region_id"), F.col("f.properties")[name_col].alias("name"), F.posexplode(parts).alias("part_id", "part"))
    return rows.select("region_id", "name", "part_id", rings.alias("rings"))


def _struct() -> str:
    return "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_properties(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Distinct values of the named properties of features, one feature a line."""
    fields = ", ".join(f"{n}: string" for n in names)
    return spark.read.schema(f"properties struct<{fields}>").json(path).select("properties.*").distinct()


def write_network(net: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``lhs rels rhs 1`` lines."""
    net.select(F.concat_ws(" ", F.col("lhs").cast("string"), format_set(F.col("rel")), F.col("rhs").cast("string"), F.lit("1")).alias("value")).write.mode(mode).text(path)


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """``lhs, rel, rhs`` of such lines, ids as text, rel a mask; a comma may stand after the set, or not."""
    part = F.split(F.trim("value"), " +")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(part, 0).alias("lhs"), parse_set(F.get(part, 1)).alias("rel"), F.get(part, 2).alias("rhs"))
