"""Operator 2: exact top-k by inner product: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 64


def integers(vectors) -> np.ndarray:
    """floor(256 * x) of each component, as doubles that are whole numbers."""
    return np.floor(256.0 * np.stack([np.asarray(v, np.float64) for v in vectors]))


class BallTree:
    """Balls halved along their widest axis, down to LEAF points. Products are exact: in doubles while every possible
    one stays below 2**53, else in Python's integers."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]
        self.wide = len(points) and np.abs(points).max() ** 2 * points.shape[1] >= 2**52
        self.root = self._build(np.arange(len(ids))) if len(ids) else None

    def _build(self, at: np.ndarray) -> tuple:
        p = self.points[at]
        center = p.mean(0)
        radius = float(np.sqrt(((p - center) ** 2).sum(1).max()))
        if len(at) <= LEAF or radius == 0 and len(at) <= 4 * LEAF:
            return center, radius, at, None
        axis = int(np.argmax(p.max(0) - p.min(0)))
        half = np.argpartition(p[:, axis], len(at) // 2)
        return center, radius, None, (self._build(np.sort(at[half[: len(at) // 2]])), self._build(np.sort(at[half[len(at) // 2 :]])))

    def _products(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = self.points[at]
        if self.wide or len(q) and np.abs(q).max() * np.abs(c).max() * c.shape[1] >= 2**52:
            # A score is a long: beyond its range it stops at the range's end.
            least, most = -(2**63), 2**63 - 1
            return np.array([[min(most, max(least, sum(int(x) * int(y) for x, y in zip(a, b)))) for b in c] for a in q], np.int64).reshape(len(q), len(c))
        return (q @ c.T).astype(np.int64)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the scores and ids of its k best points but the row ``own``, best first, and whether an entry is one.

        ``floor`` is a score that the k-th best is known to reach; all nodes share the current k-th score, and a node whose
        bound q.center + |q| radius is less is left out with all below it. Of two nodes each query takes that with the
        larger bound first.
        """
        n = len(q)
        score, ids, some = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), bool)
        kth, length = floor.astype(float).copy(), np.sqrt((q**2).sum(1))

        def bound(node: tuple, rows: np.ndarray) -> np.ndarray:
            b = q[rows] @ node[0] + length[rows] * node[1]
            return b + 1e-9 * (np.abs(b) + length[rows] * (node[1] + np.sqrt((node[0] ** 2).sum()))) + 1e-6

        def scan(at: np.ndarray, rows: np.ndarray) -> None:
            s = self._products(q[rows], at)
            ok = (self.rows[at][None, :] != own[rows][:, None]) & (s >= kth[rows][:, None])
            hit = ok.any(1)
            if not hit.any():
                return
            rows, s, ok = rows[hit], s[hit], ok[hit]
            new = np.broadcast_to(self.ids[at], s.shape)
            all_s, all_i, all_ok = np.hstack([score[rows], s]), np.hstack([ids[rows], new]), np.hstack([some[rows], ok])
            best = np.lexsort((all_i, -all_s, ~all_ok), axis=1)[:, :k]
            score[rows], ids[rows], some[rows] = (np.take_along_axis(x, best, 1) for x in (all_s, all_i, all_ok))
            full = some[rows, k - 1]
            kth[rows[full]] = np.maximum(kth[rows[full]], score[rows[full], k - 1])

        def visit(node: tuple, rows: np.ndarray) -> None:
            rows = rows[bound(node, rows) >= kth[rows]]
            if not len(rows):
                return
            if node[3] is None:
                scan(node[2], rows)
                return
            left, right = node[3]
            first = bound(left, rows) >= bound(right, rows)
            visit(left, rows[first])
            visit(right, rows[~first])
            visit(right, rows[first])
            visit(left, rows[~first])

        if self.root is not None and n:
            visit(self.root, np.arange(n))
        return score, ids, some


def _apart(asked: DataFrame) -> DataFrame:
    """Other names than the points' columns, from which they come: else the two sides are taken for one another."""
    return asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])


def _search(k: int):
    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked = asked.rename(columns=lambda c: c.removeprefix("q_"))
        # A shard that no query is asked of comes with an empty frame, which has no columns.
        for dim, q in asked.groupby("dim") if len(asked) and len(points) else ():
            p = points[points["dim"] == dim]
            if not len(p):
                continue
            tree = BallTree(integers(p["v"]), p["vec_id"].to_numpy(), p["row"].to_numpy())
            own = q["row"].to_numpy()
            floor = q["floor"].astype(float).fillna(-np.inf).to_numpy()
            score, ids, some = tree.search(integers(q["v"]), own, k, floor)
            row, col = np.nonzero(some)
            out.append(pd.DataFrame({"query_row": own[row], "query_id": q["vec_id"].to_numpy()[row], "vec_id": ids[row, col], "score": score[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = 2048, query_rows: int = 8192, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` its k best other rows by integer inner product.

    Rows fall into shards of about ``shard_rows`` by the hash of their number and queries into blocks of about
    ``query_rows``; each shard meets each block once. Before that, each query searches one shard alone; the k-th score found
    there is a floor under its final one, which prunes every other shard from the start. Of each shard's at most k rows a
    query, a window keeps the best; ties go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Vectors meet only
    those of equal length; empty ones have score 0 with each other. Rows that repeat an id are points of their own, each a candidate for
    the other; if the id is asked for, each is a query with ranks of its own. Queries with fewer than k others return them all. Other columns are not read.
    """
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n, m = rows.count(), rows.where(is_query).count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    asked = rows.where(is_query).withColumn("floor", F.lit(None).cast("long"))
    schema = "query_row long, query_id long, vec_id long, score long"
    seed = rows.groupBy("shard").cogroup(_apart(asked).groupBy("q_shard")).applyInPandas(_search(k), schema)
    floors = seed.groupBy(F.col("query_row").alias("row")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("c")).where(f"c >= {k}").drop("c")
    asked = cut(asked.drop("floor", "shard").join(floors, "row", "left"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    points = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = points.groupBy("shard", "block").cogroup(_apart(asked).groupBy("q_shard", "q_block")).applyInPandas(_search(k), schema)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
