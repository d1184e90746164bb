"""What several operators share: tables, shared folders, lineage cuts, components, grouped Python."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # a word of the contracts: no space, no \t \n \v \f \r


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a local session gets a temporary one where none is named."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder, and executors of a cluster share no temporary one")
        root = "file://" + tempfile.mkdtemp(prefix="meridian-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder below the shared root."""
    uri = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return uri


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder or file of the shared root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept_table(df: DataFrame, uri: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it again: a lineage cut for tables that are large or read by columns."""
    df.write.parquet(uri)
    return df.sparkSession.read.parquet(uri)


def running(rows: DataFrame, by: list[str], size: str, order: list[Column]) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the rows before this one, in each group of ``by``, by ``bucket``, then ``order``.

    Two levels, so that no task gets a whole group: each row has a ``bucket``; the buckets' sums are few and are added up first,
    then each bucket is added up by itself.
    """
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "bucket").agg(F.sum(size).alias("s"))
    starts = sums.withColumn("base", F.coalesce(F.sum("s").over(w), F.lit(0))).drop("s")
    inner = Window.partitionBy(*by, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return own.join(starts, [*by, "bucket"]).withColumn("before", F.col("base") + F.col("own")).drop("base", "own")


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` now and cuts its lineage with a reliable checkpoint, which outlives executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(uri: str):
    """(file system, path) of a shared URI, on the driver or an executor."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: what is made of texts at once stays small, and workers keep the memory that they once had."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def beside(ids: pa.Array, rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of ``ids`` as they came, so that nulls and ids beyond 2**53 stay exact, and the rows' values."""
    values = zip(*rows) if rows else [()] * (len(kinds) - 1)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(values, list(kinds.values())[1:], strict=True))], list(kinds))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys``, cut again so that no group spans two of them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[keys].iloc[-1]
        same = np.logical_and.reduce([pdf[k].to_numpy() == last[k] for k in keys])
        start = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            held.append(pdf.iloc[:start])
            yield pd.concat(held, ignore_index=True)
            held = []
        elif held and any(held[-1][k].iloc[-1] != last[k] for k in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(pdf.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def in_blocks(rows: DataFrame, keys: list[str], spread: Column, block: int) -> DataFrame:
    """Splits hot groups: rows of a group of n go to ceil(n / block) blocks by ``spread``, and each pair of blocks
    becomes a group of its own in column ``pair``; ``b`` is a row's block, ``own`` marks the pairs of a block with itself. Groups of one row vanish, as nothing is to be compared there.

    Any two rows of a group meet in at least one pair, so no comparison is lost; a group never holds more than about
    2 * block rows. The sizes are counted with partial aggregation and then cut, so both sides of the join are
    exchanged plainly and a hot key's side can be split at run time; sizes are never broadcast by way of the driver.
    """
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    j = rows.join(sizes.hint("merge"), keys).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    j = j.withColumn("b", F.pmod(spread, F.col("nb")).cast("int"))
    j = j.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    j = j.withColumn("pair", F.least("b", "o") * F.col("nb") + F.greatest("b", "o"))
    # The group (b, b) is of the block alone; b and o are the same in all its rows.
    return j.withColumn("own", F.col("pair") % (F.col("nb") + 1) == 0).drop("n", "nb", "o")


def spanning(nodes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the nodes of each root as a tree of at most 32 children a node: no hub, little depth."""
    order = np.lexsort((nodes, roots))
    nodes, roots = nodes[order], roots[order]
    first = np.r_[True, roots[1:] != roots[:-1]] if len(roots) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(roots)), 0))
    place = np.arange(len(roots)) - begin
    parent = begin + (place - 1) // 32
    keep = place > 0
    return nodes[keep], nodes[parent[keep]]


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by the links a-b: minima along links, then pointer jumps."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges(a, b)``; component: the smallest node reachable.

    Minima travel along links, then each label jumps to its own label, so long chains halve every round. State and links
    are checkpointed every round, nothing goes to the driver but whether a label changed: joins are by merging, as a broadcast
    takes driver memory until its garbage is collected, and each exchange holds a driver thread for a minute. After a round each link goes to
    the other end's label in place of that end, which a link to its label stands for: links that become equal are one, so a dense group
    has many links in the first round alone. Hot labels appear only in a join of two plain exchanges, which adaptive execution splits.
    """

    def both_ways(links: DataFrame) -> DataFrame:
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))

    both = both_ways(edges)
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = both.join(state.hint("merge"), F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        near = cut(near.unionByName(state.select("node", "component", F.col("component").alias("was"))).distinct())
        low = near.groupBy("node").agg(F.min("component").alias("component"), F.min("was").alias("was"))
        up = low.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = cut(low.join(up.hint("merge"), "component").select("node", F.col("top").alias("component"), "was"))
        state = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return state
        both = both_ways(near.select(F.col("node").alias("a"), F.col("component").alias("b")))


def grouped(rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs ``fn`` over frames of many whole groups at a time, sorted by ``keys``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, keys):
            yield fn(pdf)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
