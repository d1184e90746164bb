"""Operator 4 [native]: documents into shards of near-equal bytes, linked documents together, by balanced label propagation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running

HUB = ["digest", "piece"]


def _dealt(n: int, salt: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(n)).cast("int")


def netted(asked: np.ndarray, load: np.ndarray, high: float) -> np.ndarray:
    """How much of ``asked[from, to]`` may move at once so that no load passes ``high``.

    What leaves a shard makes room for what enters it, so opposite flows and whole cycles pass even where every shard is
    full. Flows into a shard that would be too full shrink until none is.
    """
    g = asked.astype(float).copy()
    for _ in range(1000):
        into, out = g.sum(0), g.sum(1)
        full = (load + into - out > high + 0.5) & (into > 0.5)
        if not full.any():
            break
        g[:, full] *= np.maximum(0, high - load + out)[full] / into[full]
    return g


def _among(values: np.ndarray, at: Column) -> Column:
    """An entry of a constant array; there is one for each shard, or each pair of them."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in values.ravel()]), at.cast("int") + 1)


def _loads(rows: DataFrame, n_shards: int, size: str = "size") -> np.ndarray:
    out = np.zeros(n_shards)
    for r in rows.groupBy("shard").agg(F.sum(size).alias("s")).collect():  # a row a shard
        out[r["shard"]] = r["s"]
    return out


def _along(rows: DataFrame, lack: np.ndarray, order: str, size: str = "size") -> DataFrame:
    """Sets ``shard``: rows lie on one line by ``bucket`` and ``order``, and each goes where its middle falls when the line is cut in proportion to ``lack``."""
    here = rows.agg(F.sum(size).alias("s")).collect()[0]["s"] or 0
    ends = np.cumsum(lack) * (here / lack.sum() if lack.sum() else 0)
    run = running(rows.withColumn("all", F.lit(0)), ["all"], size, [F.col(order)])
    middle = F.col("before") + F.col(size) / 2
    shard = sum((F.when(middle >= F.lit(float(e)), 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    return cut(run.withColumn("shard", shard).drop("all", "before"))


def propagate(cells: DataFrame, n_shards: int, high: float, buckets: int, rounds: int = 100) -> DataFrame:
    """Balanced label propagation over ``cells(digest, piece, start, size, shard)``: the documents of a hub that began in one shard.

    A round joins every cell with its hub's aim: the shard that holds most of the hub's bytes, ties by a hash of the round, so that
    either side of a pair is tried. Cells elsewhere ask to move there. The driver sees the bytes asked between each pair of shards,
    nets them under the quotas, and of each pair the smallest cells up to the grant move. A move always raises the sum over hubs
    and shards of squared bytes, so rounds end; the last is that in which nothing is granted.
    """
    load = _loads(cells, n_shards)
    for n in range(rounds):
        held = cells.groupBy(*HUB, "shard").agg(F.sum("size").alias("b"))
        aim = held.groupBy(*HUB).agg(F.max(F.struct("b", F.xxhash64(*HUB, "shard", F.lit(n)).alias("tie"), "shard")).alias("m"))
        asks = cut(cells.join(aim.select(*HUB, F.col("m.shard").alias("to")), HUB).where("shard <> to"))
        asked = np.zeros((n_shards, n_shards))
        for r in asks.groupBy("shard", "to").agg(F.sum("size").alias("s")).collect():  # a row for each pair of shards at most
            asked[r["shard"], r["to"]] = r["s"]
        grant = netted(asked, load, high)
        # Small cells first: a cell larger than the grant would keep all behind it.
        small = (F.floor(F.log2(F.col("size").cast("double"))).cast("int") * buckets + _dealt(buckets, n, *HUB)).alias("bucket")
        lined = running(asks.select("*", small), ["shard", "to"], "size", [F.col("digest"), F.col("piece"), F.col("start")])
        moves = cut(lined.where(F.col("before") + F.col("size") <= _among(grant, F.col("shard") * n_shards + F.col("to"))).select(*HUB, "start", "size", "shard", "to"))
        moved = moves.groupBy("shard", "to").agg(F.sum("size").alias("s")).collect()
        if not moved:
            break
        for r in moved:
            load[r["shard"]] -= r["s"]
            load[r["to"]] += r["s"]
        cells = cut(cells.join(moves.select(*HUB, "start", "to"), [*HUB, "start"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
        if sum(r["s"] for r in moved) == asked.sum():
            break  # every hub is whole
    return cells


def _even(cells: DataFrame, n_shards: int, mean: float) -> DataFrame:
    """Moves small hubs, whole as they lie in a shard, from shards above the mean to those below it."""
    load = _loads(cells, n_shards)
    over, lack = np.maximum(0, load - mean), np.maximum(0, mean - load)
    units = cells.groupBy(*HUB, "shard").agg(F.sum("size").alias("b"))
    most = units.agg(F.avg("b").alias("a")).collect()[0]["a"] or 0
    if over.max(initial=0) < 1 or not lack.sum():
        return cells
    small = units.where(F.col("b") <= most).where(_among(over, F.col("shard")) > 0).withColumn("bucket", _dealt(64, 7, *HUB))
    go = running(small, ["shard"], "b", [F.col("digest"), F.col("piece")])
    go = cut(go.where(F.col("before") + F.col("b") <= _among(over, F.col("shard"))).select(*HUB, F.col("shard").alias("was"), "b", "bucket"))
    there = _along(go, lack, "digest", "b").select(*HUB, F.col("was").alias("shard"), F.col("shard").alias("to"))
    return cut(cells.join(there, [*HUB, "shard"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))


def _homes(groups: list[tuple[str, int, int]], n_shards: int, high: float) -> list[tuple[str, int, int]]:
    """``digest, piece, shard`` for pieces of large groups, largest group first: where the last piece went, or where there is most room.

    A piece that fits nowhere under ``high`` gets no home; its documents start with those of the small groups.
    """
    load, out = np.zeros(n_shards), []
    for digest, size, pieces in sorted(groups, key=lambda x: (-x[1], x[0])):
        at = int(load.argmin())
        for k in range(pieces):
            at = at if load[at] + size / pieces <= high else int(load.argmin())
            if load[at] + size / pieces <= high:
                load[at] += size / pieces
                out.append((digest, k, at))
    return out


def shard_documents(docs: DataFrame, n_shards: int = 16, slack: float = 0.01, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Deals ``docs`` into shards of equal bytes: equal texts are linked, and linked documents move to one shard.

    1. Only sizes, checksums and a SHA-256 of the text are kept. A group of equal texts is a clique, held as a hub that its documents
       link to, so links grow with the documents. A group larger than a shard must be cut: its documents are hashed to hubs of
       a quarter of a shard each.
    2. Hubs of over ``slack`` of a shard (fewer than n_shards / slack) start as wholes where there is room; the other linked
       documents start on a line that fills each shard up to the same bytes, in hashed order. Labels propagate (``propagate``) under quotas of the mean
       and ``slack`` of it (the largest document, if that is more) until no move is granted, then once more under five times
       that. Small hubs then even out, as wholes, what is above the mean, and so do single documents of groups that were cut.
    3. Documents without links cut nothing. They fill what is then left, large ones first, so that shards end equal up to about one
       small document; where all are linked, up to about one small hub.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: law is always ``bytes``, grown_shard null.
    Null texts have size 1, a null checksum and no links; empty texts are equal to each other. Rows that repeat a document id, and those of
    none, are placed one by one. An empty table gives no rows. Extra columns are not read.
    """
    t = F.col(text)
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size")
    nodes = cut(docs.select(F.col(key).cast("long").alias("doc_id"), size, F.crc32(t).alias("text_crc32"), F.sha2(t, 256).alias("digest")))
    facts = nodes.agg(F.sum("size").alias("t"), F.max("size").alias("m"), F.count(F.lit(1)).alias("n")).collect()[0]
    total, largest, buckets = facts["t"] or 0, facts["m"] or 0, max(16, facts["n"] // 200_000)
    mean = max(1, total / n_shards)
    nodes = nodes.withColumn("bucket", _dealt(buckets, 3, "doc_id", "size"))

    pieces = F.when(F.col("g") > mean, F.ceil(F.col("g") / (mean / 4))).otherwise(1).cast("int").alias("pieces")
    groups = cut(nodes.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("g")).where("n > 1").select("digest", "g", pieces))
    linked = cut(nodes.join(groups.drop("g"), "digest").withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("pieces")).cast("int")))
    give = max(slack * mean, largest)
    large = [tuple(r) for r in groups.where(F.col("g") > slack * mean).collect()]  # under n_shards / slack rows
    homes = nodes.sparkSession.createDataFrame(_homes(large, n_shards, mean), "digest string, piece int, start int")
    linked = linked.join(F.broadcast(homes), HUB, "left")
    lack = np.maximum(0, linked.agg(F.sum("size").alias("s")).collect()[0]["s"] or 0) / n_shards
    home = linked.where("start is not null")
    others = _along(linked.where("start is null").drop("start"), np.maximum(0, lack - _loads(home.withColumnRenamed("start", "shard"), n_shards)), "digest")
    linked = cut(home.unionByName(others.withColumnRenamed("shard", "start")))
    cells = cut(linked.groupBy(*HUB, "start").agg(F.sum("size").alias("size")).withColumn("shard", F.col("start")))
    for k in (1, 5):  # what is still cut may go under looser quotas, as whole hubs even that out again
        cells = propagate(cells, n_shards, mean + k * give, buckets)
    cells = _even(cells, n_shards, mean)
    columns = ["doc_id", "size", "text_crc32", "bucket", "shard"]
    placed = cut(linked.join(cells.select(*HUB, "start", "shard"), [*HUB, "start"]).select(*columns, "pieces"))
    load = _loads(placed, n_shards)
    if (load > mean).any() and homes.limit(1).count():
        # Documents of a group that had to be cut are free to go one by one.
        apart = running(placed.where("pieces > 1"), ["shard"], "size", [F.col("doc_id")])
        goes = F.col("before") + F.col("size") <= _among(np.maximum(0, load - mean), F.col("shard"))
        apart = cut(apart.withColumn("goes", goes).select(*columns, "goes"))
        moved = _along(apart.where("goes").drop("shard", "goes"), np.maximum(0, mean - load), "doc_id")
        placed = placed.where("pieces = 1").select(*columns).unionByName(apart.where("not goes").select(*columns)).unionByName(moved.select(*columns))
        load = _loads(placed, n_shards)
    placed = placed.select(*columns)

    free = nodes.join(groups, "digest", "left_anti").select("doc_id", "size", "text_crc32", "bucket")
    at = free.agg(F.avg("size").alias("a")).collect()[0]["a"] or 0
    for part in (free.where(F.col("size") > at), free.where(F.col("size") <= at)):
        part = _along(part, np.maximum(0, mean - load), "doc_id").select(*columns)
        load += _loads(part, n_shards)
        placed = placed.unionByName(part)
    one = placed.withColumn("one", F.lit(1).cast("long"))
    slotted = running(one, ["shard"], "one", [F.col("doc_id")])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
