"""A graph kept in files: triples by predicate, a network, geometries; and the list of predicates to load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import graph as io
from .sparql import Pattern


def read_predicates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(host, local name) of a list of ``host/local`` lines; blank ones are passed over. The list is the user's, of tens of lines."""
    return [tuple(r[0].strip().rsplit("/", 1)) for r in spark.read.text(path).where(F.trim("value") != "").collect()]


class Store:
    """What the engine asks of a graph, from paths. Frames are lazy; a scan reads one predicate's partition.

    ``predicates``: if given, only these (host, local name) can be asked for.
    """

    def __init__(self, spark: SparkSession, triples: str, network: str | None = None, geometries: str | None = None, predicates: list[tuple[str, str]] | None = None):
        self.spark, self.paths, self.predicates = spark, (triples, network, geometries), predicates

    @classmethod
    def write(cls, spark: SparkSession, triples: DataFrame, network: DataFrame, geometries: DataFrame, path: str, mode: str = "error") -> Store:
        """Writes a graph below ``path``; by default it is an error if there is one."""
        io.write_vertical(triples, f"{path}/triples", mode)
        io.write_network(network, f"{path}/network", mode)
        geometries.write.mode(mode).parquet(f"{path}/geometries")
        return cls(spark, f"{path}/triples", f"{path}/network", f"{path}/geometries")

    def scan(self, p: Pattern) -> DataFrame:
        host = p.predicate.strip("<>").split("/")[2]
        if self.predicates is not None and (host, p.local) not in self.predicates:
            raise KeyError(f"the list of predicates has no {host}/{p.local}")
        return io.read_vertical(self.spark, self.paths[0], p.local, p.predicate)

    @property
    def network(self) -> DataFrame:
        return io.read_network(self.spark, self.paths[1])

    @property
    def geometries(self) -> DataFrame:
        return self.spark.read.parquet(self.paths[2])
