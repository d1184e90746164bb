"""Answers queries by reasoning (qual), by geometry (quan), or by both (hybrid)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rcc8 import CONTAINS, TOUCHES, WITHIN, Calculus, entails, overlaps
from ..operators import geometry, reasoner, spatial
from . import bgp
from .sparql import Group, Pattern, Query, Unsupported, is_var, parse, parse_file

ASKED = {"within": WITHIN, "contains": CONTAINS, "touches": TOUCHES}


class Engine:
    """``graph`` offers ``scan(pattern)``, ``network`` (lhs, rel, rhs; ids as terms or numbers), ``geometries``."""

    def __init__(self, spark: SparkSession, graph, calculus: Calculus | None = None, lax: bool = False):
        self.spark, self.graph, self.calculus, self.lax = spark, graph, calculus or Calculus(), lax

    def query(self, text: str | Query, mode: str = "qual") -> DataFrame:
        """The SELECT variables as text columns: one lazy plan, but for the reasoner's loop."""
        q = parse(text) if isinstance(text, str) else text
        if mode not in ("qual", "quan", "hybrid"):
            raise ValueError(f"no mode {mode!r}")
        if mode == "qual" and q.has_windows:
            raise Unsupported("a polygon has no place in the network; use quan or hybrid")
        df = self._group(q, mode)
        out = df.select(*[F.col(v[1:]) for v in q.select])
        out = out.distinct() if q.distinct else out
        if q.order:
            out = out.orderBy(*[F.desc(v[1:]) if down else F.asc(v[1:]) for v, down in q.order])
        out = out.offset(q.offset) if q.offset else out
        return out if q.limit is None else out.limit(q.limit)

    def _group(self, g: Group, mode: str) -> DataFrame:
        """The bindings of a group: its triples, relations and windows, joined with its unions, then with what is optional."""
        frames = bgp.plan(g.plain, self.graph.scan) if g.plain else []
        for choices in g.unions:
            both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._group(c, mode) for c in choices])
            frames = self._joined(both, frames)
        for p in g.spatial:
            frames = self._spatial(p, frames, "quan" if mode == "quan" else "qual")
        for var, wkt, relation in g.windows:
            hits = self.window(wkt, mode, relation).withColumnRenamed("child", var[1:])
            frames = self._joined(hits, frames)
        df = reduce(lambda a, b: a.crossJoin(b), frames)  # components that nothing links: the query asks for all combinations
        for o in g.optionals:
            other = self._group(o, mode)
            shared = [c for c in other.columns if c in df.columns]
            df = df.join(other, shared, "left") if shared else df.join(other, F.lit(True), "left")
        return df

    def _ids(self, term: str, frames: list[DataFrame]) -> DataFrame | None:
        """Candidate ids of a term: one row for a constant, a variable's bindings, or none: all."""
        if not is_var(term):
            return self.spark.createDataFrame([(term,)], "id string")
        for f in frames:
            if term[1:] in f.columns:
                return f.select(F.col(term[1:]).alias("id")).distinct()
        return None

    def _spatial(self, p: Pattern, frames: list[DataFrame], mode: str) -> list[DataFrame]:
        pairs = self.pairs(p.relation, self._ids(p.object, frames), self._ids(p.subject, frames), mode)
        for term, column in ((p.object, "parent"), (p.subject, "child")):
            if is_var(term):
                pairs = pairs.withColumnRenamed(column, term[1:])
            else:
                pairs = pairs.where(F.col(column) == term).drop(column)
        if p.subject == p.object:
            raise Unsupported("a relation of a variable with itself")
        return self._joined(pairs.distinct(), frames)

    @staticmethod
    def _joined(pairs: DataFrame, frames: list[DataFrame]) -> list[DataFrame]:
        """Joins with every frame that shares a variable, each on all that it shares."""
        rest = []
        for f in frames:
            keys = [c for c in pairs.columns if c in f.columns]
            if keys:
                pairs = pairs.join(f, keys)
            else:
                rest.append(f)
        return [pairs, *rest] if pairs.columns else [f.join(pairs.limit(1), on=F.lit(True), how="left_semi") for f in rest]

    def pairs(self, relation: str, objects: DataFrame | None, subjects: DataFrame | None, mode: str) -> DataFrame:
        """``parent`` (the query's object), ``child`` (its subject) that stand in the relation."""
        if mode == "qual":
            return self.reasoned(objects, ASKED[relation], subjects)
        g = self.graph.geometries
        every = g.select("id").distinct()
        if relation == "touches":
            return spatial.adjacency(g, objects if objects is not None else every, subjects)
        if relation == "within":
            return spatial.containment(g, objects if objects is not None else every, subjects)
        return spatial.containment(g, subjects if subjects is not None else every, objects).select(F.col("child").alias("parent"), F.col("parent").alias("child"))

    def reasoned(self, sources: DataFrame | None, asked: int, targets: DataFrame | None = None) -> DataFrame:
        """``parent, child``: what the network entails between the sources and any (or the given) targets."""
        net = reasoner.symmetrise(self.graph.network, self.calculus).persist()
        heads = net.select("lhs").distinct() if sources is None else sources.select(F.col("id").alias("lhs"))
        if asked == WITHIN and not self.lax:
            heads = reasoner.may_contain(net, heads)
        found = reasoner.closure(net, heads, self.calculus)
        net.unpersist()
        test = overlaps if self.lax else entails
        out = found.where(test(F.col("rel"), asked)).select(F.col("lhs").alias("parent"), F.col("rhs").alias("child"))
        return out if targets is None else out.join(targets.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")

    def window(self, wkt: str, mode: str, relation: str = "within") -> DataFrame:
        """``child``: what lies in a polygon (or touches it, or contains it); of what lies in it, in hybrid mode also what the network proves to be inside of that."""
        rings = geometry.parse_wkt(wkt)
        if relation != "within":
            return spatial.related_to_window(self.graph.geometries, rings, relation)
        hits = spatial.within_window(self.graph.geometries, rings)
        if mode != "hybrid":
            return hits
        reasoner.ensure_checkpoints(self.spark)
        hits = hits.checkpoint()
        found = self.reasoned(hits.select(F.col("child").alias("id")), WITHIN)
        return hits.unionByName(found.select("child")).distinct()

    def run_file(self, text: str, mode: str = "qual") -> list[tuple[Query, DataFrame]]:
        """The queries of a file, in order, each with its plan; a query's time is that of its own action."""
        return [(q, self.query(q, mode)) for q in parse_file(text)]
