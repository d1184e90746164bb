"""Reasoning over an RCC-8 network from chosen sources: composition and intersection to a fixpoint of DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rcc8 import DC, NTPP, TPP, UNIVERSAL, Calculus


class Inconsistent(ValueError):
    """Some pair has no relation left."""


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the folder that the session names; one of its own only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder, and executors of a cluster share no temporary one")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="meridian-"))


def symmetrise(net: DataFrame, calculus: Calculus) -> DataFrame:
    """The network with the converse of every edge."""
    back = net.select(F.col("rhs").alias("lhs"), calculus.converses_of(F.col("rel")).alias("rel"), F.col("lhs").alias("rhs"))
    return net.select("lhs", "rel", "rhs").unionByName(back).distinct()


def compose_step(frontier: DataFrame, net: DataFrame, table: DataFrame) -> DataFrame:
    """Edges of the frontier extended by one edge of the network; no loops, nothing that says nothing.

    The frontier meets the table first, a constant of at most 65,025 rows, so broadcast: what is left is the relations by which an edge says
    something at all, and only network edges with one of them are joined. Two customers of one nation never meet.
    """
    n = net.select(F.col("lhs").alias("via"), F.col("rel").alias("r2"), F.col("rhs").alias("to"))
    says = F.broadcast(table.where(F.col("comp") != UNIVERSAL))
    f = frontier.select("lhs", F.col("rel").alias("r1"), F.col("rhs").alias("via")).join(says, "r1")
    return f.join(n, ["via", "r2"]).where("lhs <> to").select("lhs", F.col("comp").alias("rel"), F.col("to").alias("rhs"))


def refine_step(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``lhs, rhs, rel, was``: relations intersected for each pair; ``was`` is what the pair had before, if anything."""
    old = edges.select("lhs", "rhs", "rel", F.col("rel").alias("was"))
    both = old.unionByName(new.select("lhs", "rhs", "rel", F.lit(None).cast("int").alias("was")))
    return both.groupBy("lhs", "rhs").agg(F.bit_and("rel").alias("rel"), F.max("was").alias("was"))


def sources_of(net: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges whose head is in ``sources(lhs)``."""
    return net.join(sources, "lhs", "left_semi")


def may_contain(net: DataFrame, sources: DataFrame) -> DataFrame:
    """Those of ``sources(lhs)`` that the network may prove to contain something.

    A source whose every edge stays true when it shrinks to a small disc inside itself (it lies inside its partner, or may be apart from it) cannot
    be proved to contain anything, as the disc could be chosen to miss that.
    """
    shrinks = [NTPP, TPP | NTPP, DC, DC | NTPP, DC | TPP | NTPP]
    return sources.join(net.where(~F.col("rel").isin(shrinks)).select("lhs").distinct(), "lhs", "left_semi")


def closure(net: DataFrame, sources: DataFrame, calculus: Calculus, most: int = 100) -> DataFrame:
    """``lhs, rel, rhs`` for what the symmetric network entails from ``sources(lhs)``.

    Edges only grow on their right, by base edges; new or tightened ones make up the next frontier, and an
    empty frontier ends the loop. Each round is one join, one aggregation and one checkpoint; the driver sees a count. A pair without a
    relation raises Inconsistent.
    """
    spark = net.sparkSession
    ensure_checkpoints(spark)
    start = {r[0] for r in net.select("rel").distinct().collect()}  # at most 255 masks
    # Edges grow by edges of the network, so r2 is one of its own relations.
    table = calculus.compositions(spark, calculus.reachable(start)).where(F.col("r2").isin([int(r) for r in start])).cache()
    edges = sources_of(net, sources).groupBy("lhs", "rhs").agg(F.bit_and("rel").alias("rel"), F.lit(None).cast("int").alias("was")).checkpoint()
    try:
        for _ in range(most):
            if edges.where("rel = 0").limit(1).count():
                raise Inconsistent("the network leaves some pair without a relation")
            frontier = edges.where("was is null or rel <> was")
            if not frontier.limit(1).count():
                return edges.select("lhs", "rel", "rhs")
            edges = refine_step(edges.drop("was"), compose_step(frontier, net, table)).checkpoint()
        raise RuntimeError(f"no fixpoint after {most} rounds")
    finally:
        table.unpersist()
