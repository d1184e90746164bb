"""Operator 6: mixes sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Shares of sum(sizes) by weight; a share stops at ``most`` times its size and the rest is shared again by weight.

    The end of that sharing is min(most * size, level * weight) with one level for all, found from the sorted caps.
    """
    cap, total = most * sizes.astype(float), float(sizes.sum())
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        share = (total - out[~open_].sum()) * weights / weights[open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over], open_ = cap[over], open_ & ~over
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1), at most ``caps`` each; ties go to the earlier entry.

    Holders have round(votes / divisor) seats for one common divisor, so it is bisected and the last few seats are dealt
    by quotient: as many steps for a million seats as for ten.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    caps = np.where(votes > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats == caps.sum():
        return caps
    low, high = 0.0, 2 * votes.max(initial=0) + 1
    fill = lambda d: np.minimum(caps, np.floor(votes / d + 0.5)).astype(np.int64) if d > 0 else caps
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if fill(mid).sum() <= seats else (mid, high)
    got = fill(high)
    while (left := seats - int(got.sum())) > 0:
        q = np.where(got < caps, votes / (2 * got + 1), -1.0)
        for i in np.argsort(-q, kind="stable")[:left]:
            if q[i] > 0:
                got[i] += 1
    return got


def mix_sources(spark: SparkSession, docs: DataFrame, block: int = 64, most_streams: int = 256, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    A source's documents fall into streams by the hash of their id: one for each 1,024 blocks of its words, at most ``most_streams``. The
    words of a stream are in seeded order, cut into blocks of equal length near ``block`` words. Sainte-Lague gives each source
    its blocks for its target, then each of its streams its share of them, at most three rounds of what is there. A quota of q of n
    blocks takes every block q // n times, and q % n of them, from a seeded start around the stream, once more. No
    document is read more than three times, and the sums meet the targets up to the rounding of single blocks.

    Adds ``size, source_size, target, taken`` to the columns of ``docs``, in place of columns of these names (names that begin with ``_mix_``
    are used inside). Null texts and texts without words have size 0 and take 0. A null source is a source, last in order.
    Repeated rows, and those of null ids, are separate documents. An empty table gives no rows. Only one sum for each source and hash
    (of ``most_streams``) reaches the driver; the list of sources is bounded by the mix's own weights.
    """
    d = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).drop("source_size", "target", "taken")
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(most_streams)).cast("int")
    sums = d.groupBy("source", hashed.alias("h")).agg(F.sum("size").alias("n")).collect()
    names = sorted({r["source"] for r in sums}, key=lambda s: (s is None, [] if s is None else [ord(c) for c in s]))
    at = {s: i for i, s in enumerate(names)}
    by_hash = np.zeros((len(names), most_streams), np.int64)
    for r in sums:
        by_hash[at[r["source"]], r["h"]] += r["n"]
    size = by_hash.sum(1)
    goal = targets(size, np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])) if len(names) else np.zeros(0)
    streams = np.clip(size // (block * 1024), 1, most_streams)
    words = [np.bincount(np.arange(most_streams) % k, by_hash[i], k).astype(np.int64) for i, k in enumerate(streams)]
    blocks = [np.where(n > 0, np.maximum(1, np.rint(n / block)), 0).astype(np.int64) for n in words]
    quota = [np.zeros_like(b) for b in blocks]
    if size.sum():
        # A stream's blocks are words / blocks long, not just ``block``: votes are in such blocks.
        count = np.array([b.sum() for b in blocks])
        votes = goal / np.maximum(size / np.maximum(1, count), 1e-9)
        each = sainte_lague(votes, round(float(votes.sum())), MOST * count)
        quota = [sainte_lague(n, int(q), MOST * b) for n, q, b in zip(words, each, blocks)]
    kind = T.StructType([T.StructField("_mix_source", T.StringType()), T.StructField("_mix_h", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("source_size", "_mix_n", "_mix_blocks", "_mix_quota")], T.StructField("target", T.DoubleType())])
    rows = [(s, h, int(size[i]), int(words[i][h]), max(1, int(blocks[i][h])), int(quota[i][h]), float(goal[i])) for s, i in at.items() for h in range(streams[i])]
    plan = spark.createDataFrame(rows, kind)
    counts = spark.createDataFrame([(s, int(streams[i])) for s, i in at.items()], "_mix_source string, _mix_streams int")
    same = F.col("source").eqNullSafe(F.col("_mix_source"))
    d = d.join(F.broadcast(counts), same).drop("_mix_source")  # a row for each source, as on the driver
    d = d.withColumn("_mix_at", F.pmod(hashed, F.col("_mix_streams"))).drop("_mix_streams")
    w = Window.partitionBy("source", "_mix_at").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", F.xxhash64("text"))
    d = d.withColumn("_mix_to", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumn("_mix_from", F.col("_mix_to") - F.col("size")).join(plan, same & (F.col("_mix_at") == F.col("_mix_h")))
    full, extra = F.expr("coalesce(_mix_quota div _mix_blocks, 0)"), F.expr("coalesce(_mix_quota % _mix_blocks, 0)")
    start = F.expr(f"coalesce(pmod(xxhash64(source, _mix_h, {seed + 2}), _mix_blocks), 0)")
    edge = lambda i: F.floor(i * F.col("_mix_n") / F.col("_mix_blocks"))
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_mix_to"), b) - F.greatest(F.col("_mix_from"), a))
    end = start + extra
    # The run of blocks may pass the stream's end and go on at its beginning.
    once = over(edge(start), edge(F.least(end, F.col("_mix_blocks")))) + over(F.lit(0), edge(F.greatest(F.lit(0), end - F.col("_mix_blocks"))))
    taken = F.when(F.col("size") > 0, full * F.col("size") + F.when(extra > 0, once).otherwise(0)).otherwise(0).cast("long")
    return d.withColumn("taken", taken).drop(*[c for c in d.columns if c.startswith("_mix_")])
