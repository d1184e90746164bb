"""Operator 9: a quality classifier by nearest-neighbour votes over latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_column

WORDS, SHAPES, KEPT = 2048, 1024, 400_000
_terms: dict[str, tuple[int, int]] = {}


def _shape(word: str) -> str:
    """A word's outline: runs of letters by case, digits, and its other characters as they are."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][:1].isupper() else "a", word)
    return re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "0", s))[:12]


def _term(word: str) -> tuple[int, int]:
    raw = word.lower().encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) % WORDS, WORDS + zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % SHAPES


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, counts' square roots) of a whole text: hashed words, word outlines, and bins of how often words repeat."""
    if len(_terms) > KEPT:
        _terms.clear()
    words = (text or "").split()
    counts = Counter(words)
    for w in [w for w in counts if w not in _terms]:
        _terms[w] = _term(w)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0)
    pairs = np.array(list(map(_terms.__getitem__, counts)), np.int64)
    n = np.fromiter(counts.values(), float, len(counts))
    full = np.bincount(pairs.ravel(), np.repeat(n, 2), WORDS + SHAPES)
    last = Counter(map(str.__eq__, words, words[1:]))[True] / len(words)
    for i, x in enumerate((last, len(counts) / len(words), max(counts.values()) / len(words))):
        full[WORDS + zlib.crc32(f"bin {i} {int(8 * x)}".encode()) % SHAPES] += 0.5 * len(words)
    at = np.flatnonzero(full)
    return at.astype(np.int32), np.sqrt(full[at])


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), WORDS + SHAPES))
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    return x


class Voter:
    """Labelled vectors in the space of a truncated singular value decomposition, and the votes of the nearest."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 48, near: int = 25, block: int = 256):
        self.near, self.prior = near, float(labels.mean()) if len(labels) else 0.5
        seen = np.zeros(WORDS + SHAPES)
        for at, _ in rows:
            seen[at] += 1
        self.idf = np.log((1 + len(rows)) / (1 + seen)) + 1
        self.axes = self._axes(rows, rank, block)
        projected = [self._unit(y @ self.axes) for y in self._blocks(rows, block)]
        self.vectors, self.labels = np.concatenate(projected or [np.zeros((0, rank))]), labels.astype(float)

    def _blocks(self, rows: list, block: int) -> Iterator[np.ndarray]:
        for i in range(0, len(rows), block):
            yield self._weigh(dense(rows[i : i + block]))

    def _axes(self, rows: list, rank: int, block: int, more: int = 16, rounds: int = 12) -> np.ndarray:
        """The first right singular vectors, by seeded subspace iteration: a block of dense rows at a time is in memory, no Gram matrix."""
        q = np.linalg.qr(np.random.default_rng(9).standard_normal((WORDS + SHAPES, rank + more)))[0]
        for _ in range(rounds if rows else 0):
            q = np.linalg.qr(sum(y.T @ (y @ q) for y in self._blocks(rows, block)))[0]
        small = sum(((y @ q).T @ (y @ q) for y in self._blocks(rows, block)), np.zeros((rank + more, rank + more)))
        values, vectors = np.linalg.eigh(small)
        return q @ vectors[:, np.argsort(-values)[:rank]]

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        y = x * self.idf
        for part in (slice(0, WORDS), slice(WORDS, None)):
            y[:, part] /= np.maximum(np.linalg.norm(y[:, part], axis=1, keepdims=True), 1e-12)
        y[:, WORDS:] *= 2
        return y

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors by exact cosine."""
        some = np.flatnonzero(x.any(1))
        out = np.full(len(x), self.prior)
        if not len(self.labels) or not len(some):
            return out
        k = min(self.near, len(self.labels))
        cosine = self._unit(self._weigh(x[some]) @ self.axes) @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 8 + 1e-9
        out[some] = np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, rank: int = 48, near: int = 25) -> Voter:
    """Learns from at most ``sample`` labelled documents outside the held-out third, chosen by the hash of their ids.

    The bound keeps the driver's share constant: ``sample`` sparse rows come to it, whatever the input's size.
    """
    rows = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
    chosen = {r["doc_id"]: r["quality"] for r in rows.collect()}
    if not chosen:
        return Voter([], np.zeros(0), rank, near)
    few = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, quality int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "at": [g[0].astype("<i2").tobytes() for g in got], "v": [g[1].astype("<f4").tobytes() for g in got]})

    # A document that stands there more than once teaches once.
    seen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi").mapInPandas(run, "doc_id long, at binary, v binary")
    found = {r["doc_id"]: (np.frombuffer(r["at"], "<i2"), np.frombuffer(r["v"], "<f4")) for r in seen.toLocalIterator()}
    ids = sorted(found)
    return Voter([found[i] for i in ids], np.array([chosen[i] for i in ids]), rank, near)


def held_out(key: str = "doc_id"):
    """Whether crc32(id as text) mod 3 is 1: such rows teach nothing. Null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def score_documents(spark: SparkSession, docs: DataFrame, model: Voter, block: int = 256) -> DataFrame:
    """``docs`` with ``quality_score`` (in place of a column of that name): each whole text against every labelled vector, in blocks of rows.

    Texts without words, null ones too, get the share of label 1 among the labelled. Rows are scored one by one, so repeated
    rows score alike. The broadcast model is bounded by fit()'s sample.
    """
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")
    # Columns not needed for a score stay beside it; they travel with the row.
    schema = docs.select("*", F.lit(0.0).alias("quality_score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [shared.value.score(dense([features(t) for t in texts[i : i + block]])) for i in range(0, len(texts), block)]
            yield with_column(batch, "quality_score", pa.array(np.concatenate(out) if out else np.zeros(0)))

    return docs.mapInArrow(run, schema)
