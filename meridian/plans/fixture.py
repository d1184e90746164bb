"""The sales tables seen as a graph of regions, nations, customers and suppliers with places in the plane."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rcc8 import EC, NTPP, TPP
from ..operators import geometry as G
from ..operators.network import counted
from .sparql import Pattern

BASE, SCHEMA = "http://example.org/resource/", "http://schema.org/"
TYPES = {"region": "Continent", "nation": "Country", "customer": "Person", "supplier": "Organization"}


def term(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<{BASE}{kind}_"), key.cast("string"), F.lit(">"))


class Fixture:
    """Frames are lazy; one predicate is read from one table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        n = F.col("n_nationkey")
        self.region = read("region").select(term("region", F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("r"))
        self.nation = read("nation").select(term("nation", n).alias("id"), F.col("n_name").alias("name"), n.alias("n"), term("region", F.col("n_regionkey")).alias("parent"), (10 * (n % 5)).cast("double").alias("x0"), (10 * F.floor(n / 5)).cast("double").alias("y0"))
        place = lambda c: ((10 * (c % 5)).cast("double"), (10 * F.floor(c / 5)).cast("double"))
        x0, y0 = place(F.col("c_nationkey"))
        c = F.col("c_custkey")
        self.customer = read("customer").select(term("customer", c).alias("id"), F.col("c_name").alias("name"), term("nation", F.col("c_nationkey")).alias("parent"), term("segment", F.col("c_mktsegment")).alias("segment"), (x0 + 0.5 + c % 9).alias("x"), (y0 + 0.5 + F.floor(c / 9) % 9).alias("y"))
        k = F.col("s_suppkey")
        self.supplier = read("supplier").select(term("supplier", k).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"), term("nation", F.col("s_nationkey")).alias("parent"), k.alias("s"))

    def predicate(self, local: str) -> DataFrame:
        """``subject, predicate, object`` of one predicate."""
        iri = "<http://www.w3.org/2000/01/rdf-schema#label>" if local == "label" else "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>" if local == "type" else f"<{SCHEMA}{local}>"
        rows = lambda df, o: df.select(F.col("id").alias("subject"), F.lit(iri).alias("predicate"), o.alias("object"))
        all_ = {"region": self.region, "nation": self.nation, "customer": self.customer, "supplier": self.supplier}
        if local == "type":
            parts = [rows(df, F.lit(f"<{SCHEMA}{TYPES[k]}>")) for k, df in all_.items()]
        elif local == "label":
            text = lambda lang: F.concat(F.lit('"'), F.col("name"), F.lit(f'"@{lang}'))
            parts = [*[rows(df, text("en")) for df in all_.values()], rows(self.nation.where("n % 2 = 0"), text("de"))]
        elif local == "containedInPlace":
            parts = [rows(df, F.col("parent")) for df in (self.nation, self.customer, self.supplier)]
        elif local == "memberOf":
            parts = [rows(self.customer, F.col("segment"))]
        elif local == "birthPlace":
            parts = [rows(self.customer, F.col("parent"))]
        elif local == "geo":
            text = F.concat(F.lit("<geo:"), F.col("y").cast("string"), F.lit(","), F.col("x").cast("string"), F.lit(">"))
            parts = [rows(self.points, text)]
        elif local == "dissolutionDate":
            parts = [rows(self.nation.where("n % 10 = 9"), F.lit('"1999-12-31"'))]
        else:
            raise KeyError(f"the graph has no predicate {local}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    PREDICATES = ("type", "label", "containedInPlace", "memberOf", "birthPlace", "geo", "dissolutionDate")

    @cached_property
    def triples(self) -> DataFrame:
        out = self.predicate(self.PREDICATES[0])
        for p in self.PREDICATES[1:]:
            out = out.unionByName(self.predicate(p))
        return out

    def scan(self, p: Pattern) -> DataFrame:
        return self.predicate(p.local)

    def _corner(self, n: Column) -> tuple[Column, Column]:
        return (10 * (n % 5)).cast("double"), (10 * F.floor(n / 5)).cast("double")

    @cached_property
    def supplier_parts(self) -> DataFrame:
        """Two unit squares; the second of every seventh supplier lies in the next nation."""
        s, n = F.col("s"), F.col("n")
        far = F.when(s % 7 == 0, (n + 1) % 25).otherwise(n)
        (ax, ay), (bx, by) = self._corner(n), self._corner(far)
        first = F.struct(F.lit(0).alias("part_id"), (ax + 1 + s % 7).alias("x"), (ay + 1 + F.floor(s / 7) % 7).alias("y"))
        second = F.struct(F.lit(1).alias("part_id"), (bx + 1 + (s + 3) % 7).alias("x"), (by + 1 + (F.floor(s / 7) + 3) % 7).alias("y"))
        rows = self.supplier.select("id", "parent", F.explode(F.array(first, second)).alias("p")).select("id", "parent", "p.*")
        return rows.select("id", "parent", "part_id", "x", "y", G.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("rings"))

    @cached_property
    def points(self) -> DataFrame:
        first = self.supplier_parts.where("part_id = 0").select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
        return self.customer.select("id", "x", "y").unionByName(first)

    @cached_property
    def nation_areas(self) -> DataFrame:
        x, y = F.col("x0"), F.col("y0")
        return self.nation.select("id", "name", F.lit(0).alias("part_id"), G.box(x, y, x + 10, y + 10).alias("rings"))

    @cached_property
    def region_areas(self) -> DataFrame:
        x = (10 * F.col("r")).cast("double")
        return self.region.select("id", "name", F.lit(0).alias("part_id"), G.box(x, F.lit(0.0), x + 10, F.lit(50.0)).alias("rings"))

    @cached_property
    def areas(self) -> DataFrame:
        """``id, part_id, rings, count`` and envelope of regions, nations and suppliers."""
        parts = [d.select("id", "part_id", "rings") for d in (self.region_areas, self.nation_areas, self.supplier_parts)]
        return G.with_envelope(counted(parts[0].unionByName(parts[1]).unionByName(parts[2])))

    @cached_property
    def geometries(self) -> DataFrame:
        """The areas and the customers' points."""
        people = self.customer.select("id", F.lit(0).alias("part_id"), G.point(F.col("x"), F.col("y")).alias("rings"), F.lit(1).cast("long").alias("count"))
        return self.areas.unionByName(G.with_envelope(people))

    @cached_property
    def network(self) -> DataFrame:
        """``lhs, rel, rhs``, ids as terms: customers in nations, nations in regions, neighbours touching."""
        edge = lambda df, rel, to: df.select(F.col("id").alias("lhs"), F.lit(rel).alias("rel"), to.alias("rhs"))
        a, b = self.nation.alias("a"), self.nation.alias("b")
        near = (F.abs(F.col("a.x0") - F.col("b.x0")) <= 10) & (F.abs(F.col("a.y0") - F.col("b.y0")) <= 10) & (F.col("a.n") < F.col("b.n"))
        nations = F.broadcast(b)  # 25 rows by the tables' own definition
        ec = a.join(nations, near).select(F.col("a.id").alias("lhs"), F.lit(EC).alias("rel"), F.col("b.id").alias("rhs"))
        r, s = self.region.alias("r"), self.region.alias("s")
        strips = r.join(F.broadcast(s), F.col("s.r") == F.col("r.r") + 1).select(F.col("r.id").alias("lhs"), F.lit(EC).alias("rel"), F.col("s.id").alias("rhs"))
        return edge(self.customer, NTPP, F.col("parent")).unionByName(edge(self.nation, TPP | NTPP, F.col("parent"))).unionByName(ec).unionByName(strips)
