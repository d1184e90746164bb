"""Building the RCC-8 network, geometry tables and the dictionary of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rcc8 import EC, NTPP, TPP

EDGE = ["subject", "rel", "object"]


def edges(df: DataFrame, subject: Column, rel: int, obj: Column) -> DataFrame:
    return df.select(subject.alias("subject"), F.lit(rel).alias("rel"), obj.alias("object"))


def from_points(placed: DataFrame) -> DataFrame:
    """Points are strictly inside the region that they were found in."""
    return edges(placed, F.col("subject"), NTPP, F.col("region_id"))


def from_contained(contained: DataFrame) -> DataFrame:
    """One ``containedInPlace`` for each subject: the smallest object."""
    return edges(contained.groupBy("subject").agg(F.min("object").alias("object")), F.col("subject"), NTPP, F.col("object"))


def from_region_ids(regions: DataFrame) -> DataFrame:
    """A second-layer region is in its parent, whose id is its own first three characters."""
    return edges(regions.select("region_id").distinct(), F.col("region_id"), TPP | NTPP, F.substring("region_id", 1, 3))


def from_touching(pairs: DataFrame) -> DataFrame:
    """Undirected pairs, each once."""
    a, b = F.col("region_id1"), F.col("region_id2")
    return edges(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), F.col("a"), EC, F.col("b"))


def substitute(df: DataFrame, column: str, matches: DataFrame) -> DataFrame:
    """``column`` with the subject that matches(subject, region_id) has for a region id; other values stay."""
    m = matches.select(F.col("subject").alias("to_"), F.col("region_id").alias(column))
    return df.join(m, column, "left").withColumn(column, F.coalesce("to_", column)).select(*df.columns)


def without(df: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows whose subject is not a matched region."""
    return df.join(matches.select("subject"), "subject", "left_anti")


def clean_containers(rows: DataFrame, region_edges: DataFrame, contained: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows whose subject does not contain a matched region by either source."""
    both = region_edges.select("subject", "object").unionByName(contained.select("subject", "object"))
    containers = both.join(matches.select("subject"), "subject", "left_semi").select(F.col("object").alias("subject")).distinct()
    return rows.join(containers, "subject", "left_anti")


def resolve(gadm: DataFrame, quan: DataFrame, qual: DataFrame) -> DataFrame:
    """One containment for each subject: of gadm, then quan, then qual; the smaller object within one."""
    parts = [d.select(*EDGE, F.lit(i).alias("priority")) for i, d in enumerate((gadm, quan, qual))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = rows.groupBy("subject").agg(F.min(F.struct("priority", "object", "rel")).alias("b"))
    return best.select("subject", F.col("b.rel").alias("rel"), F.col("b.object").alias("object"))


def build_network(placed: DataFrame, contained: DataFrame, layer1_regions: DataFrame, touching: DataFrame, matches: DataFrame) -> DataFrame:
    """All of the above in order; returns ``subject, rel, object``, one direction for each edge."""
    gadm = substitute(substitute(from_region_ids(layer1_regions), "subject", matches), "object", matches)
    quan = substitute(from_points(without(placed, matches)), "object", matches)
    qual = from_contained(contained)
    quan, qual = clean_containers(quan, gadm, qual, matches), clean_containers(qual, gadm, qual, matches)
    ec = substitute(substitute(from_touching(touching), "subject", matches), "object", matches)
    return resolve(gadm, quan, qual).unionByName(ec)


def counted(parts: DataFrame) -> DataFrame:
    """With ``count``: rows of the same id, by a window instead of a join back."""
    return parts.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("id")))


def build_geometries(regions: DataFrame, points: DataFrame, matches: DataFrame) -> DataFrame:
    """``id, part_id, rings, count``: regions under their matched subjects' names, and points that are no matched region."""
    m = matches.select(F.col("subject").alias("to_"), "region_id")
    r = regions.join(m, "region_id", "left").select(F.coalesce("to_", "region_id").alias("id"), "part_id", "rings")
    p = without(points, matches).select(F.col("subject").alias("id"), F.lit(0).alias("part_id"), "rings")
    return counted(r.unionByName(p))


def build_dictionary(net: DataFrame, a: str = "subject", b: str = "object") -> DataFrame:
    """``id, encodedId``: an injective number for each term. Numbers are unique, not dense, so no task sees all terms."""
    ids = net.select(F.col(a).alias("id")).unionByName(net.select(F.col(b).alias("id"))).distinct()
    return ids.withColumn("encodedId", F.monotonically_increasing_id())


def encode(net: DataFrame, dictionary: DataFrame) -> DataFrame:
    left = dictionary.select(F.col("id").alias("subject"), F.col("encodedId").alias("lhs"))
    right = dictionary.select(F.col("id").alias("object"), F.col("encodedId").alias("rhs"))
    return net.join(left, "subject").join(right, "object").select("lhs", "rel", "rhs")


def decode(pairs: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        pairs = pairs.join(dictionary.select(F.col("id").alias("to_"), F.col("encodedId").alias(c)), c).drop(c).withColumnRenamed("to_", c)
    return pairs
