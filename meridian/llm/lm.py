"""Operator 5: language-model scores by a weighted backoff automaton over trigrams, bigrams and words."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import math
import pickle
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, kept_table, shared_folder

END, START = "", " "  # neither can be a word
SLICE = 1 << 21  # characters whose words are told apart at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def trains(doc_id: int | None) -> bool:
    """Whether a document is learnt from: crc32(id as text) mod 7 is not 2."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def _number(word: str) -> int:
    """A 64-bit number that names a word in counting. Two of 10**8 words share one in one of 3,700 corpora."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 5)


def _pack(a: np.ndarray) -> bytes:
    """Numbers, compressed by byte planes."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpack(b: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _joined(values, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([_unpack(b, kind) for b in values] or [np.zeros(0, kind)])


def _pack_names(name: np.ndarray) -> bytes:
    """Names of one bucket that grow, -1 among them: only the steps from one to the next are written, 0 for -1."""
    d, ok = np.zeros(len(name), np.int64), name >= 0
    d[ok] = np.diff(name[ok] & 0xFFFFFFFF, prepend=-1)
    return _pack(d)


def _names(b: bytes, bucket: int) -> np.ndarray:
    d = _unpack(b)
    return np.where(d > 0, (bucket << 32) + np.cumsum(d) - 1, -1)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``bucket, start, end`` of each run in sorted buckets."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    yield from zip(bucket[start].tolist(), start.tolist(), [*start[1:].tolist(), len(bucket)])


def _words(texts: list[str | None]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words each text has, and the words of all: runs without ASCII white space, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat, doc = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty ones
    return np.bincount(doc[some.to_numpy(zero_copy_only=False)], minlength=len(texts)), flat.filter(some).dictionary_encode()


class Part(NamedTuple):
    """A part of the documents: words as ranks among the part's words by number; ``ends`` of documents; ``first``: START's rank."""

    ids: list
    train: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    first: int

    @property
    def starts(self) -> np.ndarray:
        return np.r_[0, self.ends[:-1]]

    def before(self) -> np.ndarray:
        """The word before each, START at a document's begin."""
        out = np.empty_like(self.words)
        out[1:] = self.words[:-1]
        out[self.starts] = self.first
        return out

    def learnt(self) -> np.ndarray:
        return np.repeat(self.train, np.diff(self.ends, prepend=0))


class _Gathered:
    """Documents as the task that first reads them leaves them: a file for each part in the shared folder, and its words' counts."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self._empty()

    def _empty(self) -> None:
        self.ids, self.ranks, self.lengths, self.bytes, self.at = [], [], [], 0, defaultdict(itertools.count().__next__)
        self.at[START], self.at[END]

    def add(self, ids: list, texts: list, size: int) -> None:
        n, words = _words(texts)
        local = np.fromiter(map(self.at.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int32, len(words.dictionary))
        out = np.full(n.sum() + len(n), self.at[END], np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n + 1) - 1] = False  # each document's end
        out[inner] = local[words.indices.to_numpy()]
        self.ids += ids
        self.ranks.append(out)
        self.lengths.append(n + 1)
        self.bytes += size + 64 * len(ids)

    def close(self) -> pd.DataFrame:
        part = uuid.uuid4().int >> 65
        key = np.fromiter(map(_number, self.at), np.uint64, len(self.at))
        order = np.argsort(key)
        rank = np.empty(len(key), np.int32)
        rank[order] = np.arange(len(key))
        met = np.concatenate(self.ranks)  # frequent words are met early, and small numbers pack well
        whole = Part(self.ids, np.array([trains(i) for i in self.ids], bool), np.cumsum(np.concatenate(self.lengths)), rank[met], int(rank[0]))
        _save(self.folder, part, "docs", (whole.ids, whole.train, whole.ends, _pack(met), _pack(rank)))
        n = np.bincount(whole.words[whole.learnt()], minlength=len(key))
        n[whole.first] = whole.train.sum()
        key = key[order]
        self._empty()
        _give_back()
        # A bucket is a range of numbers, so buckets in order are words in order.
        bucket = ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        rows = [(part, b, _pack(key[i:j]), _pack(n[i:j])) for b, i, j in _slices(bucket)]
        return pd.DataFrame(rows, columns=["part", "bucket", "word", "n"])


def _save(folder: str, part: int, name: str, what) -> None:
    import zstandard

    fs, top = filesystem(folder)
    with fs.open_output_stream(f"{top}/{part:016x}.{name}", compression=None) as out:
        out.write(zstandard.ZstdCompressor(level=1).compress(pickle.dumps(what)))


def _load(folder: str, part: int, name: str):
    import zstandard

    fs, top = filesystem(folder)
    with fs.open_input_stream(f"{top}/{part:016x}.{name}", compression=None) as f:
        return pickle.loads(zstandard.ZstdDecompressor().decompress(f.read()))


def _part(folder: str, part: int) -> Part:
    ids, train, ends, met, rank = _load(folder, part, "docs")
    rank = _unpack(rank, np.int32)
    return Part(ids, train, ends, rank[_unpack(met, np.int32)], int(rank[0]))


def _split(folder: str, most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Gathered(folder, buckets)
        out = lambda: pa.RecordBatch.from_pandas(part.close(), COUNTS, preserve_index=False)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            upto = np.cumsum([0, *(len(t or "") for t in texts)])
            i = 0
            while i < len(texts):
                # At least one text, and more while they stay under SLICE.
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE, "right")) - 1)
                part.add(ids[i:j], texts[i:j], int(upto[j] - upto[i]))
                i = j
                if part.bytes >= most:
                    yield out()
        if part.ids:
            yield out()

    return run


COUNTS = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("word", pa.binary()), ("n", pa.binary())])


def _word_totals(least: int):
    """Of a bucket of words: each part's totals and names of states (-1: none); sums of the bucket in one of the rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack(b, np.uint64) for b in pdf["word"]]
        word, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(word), np.int64)
        np.add.at(total, at, _joined(pdf["n"]))
        start = word == np.uint64(_number(START))
        state = (total >= least) | start
        name = np.where(state, (int(pdf["bucket"].iloc[0]) << 32) + np.cumsum(state) - 1, -1)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        out = pdf[["part", "bucket"]].copy()
        out["total"] = [_pack(total[i]) for i in np.split(at, ends)]
        out["name"] = [_pack_names(name[i]) for i in np.split(at, ends)]
        sums = {"tokens": total[~start].sum(), "distinct": (total[~start] > 0).sum(), "documents": total[start].sum()}
        for k, x in sums.items():
            out[k] = np.r_[x, np.zeros(len(out) - 1, np.int64)]
        _give_back()
        return out

    return run


def _shift(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h.astype(np.uint64) * _ODD >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Steps(NamedTuple):
    """The distinct steps of a part, sorted by bucket, ``h`` and ``w``; ``taken``: which of them each token is, or -1."""

    taken: np.ndarray
    h: np.ndarray
    w: np.ndarray
    bucket: np.ndarray


def _taken(part: Part, names: list[np.ndarray], buckets: int) -> list[Steps]:
    """Steps between states: with the names of the part's words from a word to the next; with those of its pairs then from two words to the last two.

    Three words are a step only if both their pairs are arcs, as no other three words can be one. A step's bucket is that of w's name,
    shifted by a hash of h: so steps to one word are spread, and w's bucket need not be sent.
    """
    h, w, out = part.before(), part.words, []
    for name in names:
        known = np.r_[name >= 0, False]  # the last is of index -1
        at = np.flatnonzero(known[h] & known[w])
        code, step = np.unique(h[at].astype(np.int64) * len(name) + w[at], return_inverse=True)
        hs, ws = (name[code // len(name)], name[code % len(name)]) if len(code) else (code, code)
        bucket = ((ws >> 32) + _shift(hs, buckets)) % buckets
        by = np.argsort(bucket, kind="stable")  # names grow with ranks, so h is sorted in each bucket
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by))
        taken = np.full(len(part.words), -1, np.int32)
        taken[at] = place[step]
        out.append(Steps(taken, hs[by], ws[by], bucket[by]))
        w = taken
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[part.starts] = -1
    return out


def _part_names(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([_names(b, k) for b, k in zip(pdf["name"], pdf["bucket"])] or [np.zeros(0, np.int64)])


def _steps(folder: str, buckets: int):
    """The distinct steps of a part's documents, by bucket, and how often learnt ones take them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, pdf = int(pdf["part"].iloc[0]), pdf.sort_values("bucket")
        part = _part(folder, number)
        taken, h, w, bucket = _taken(part, [_part_names(x) for _, x in pdf.groupby("kind")], buckets)[-1]
        n = np.bincount(taken[(taken >= 0) & part.learnt()], minlength=len(h))
        rows = [(number, b, _pack(np.diff(h[i:j], prepend=0)), _pack(w[i:j] & 0xFFFFFFFF), _pack(n[i:j])) for b, i, j in _slices(bucket)]
        del part, taken, h, w, n, bucket
        _give_back()
        return pd.DataFrame(rows, columns=["part", "bucket", "h", "w", "n"])

    return run


def _step_totals(arc_least: int, buckets: int):
    """Of a bucket of steps: each part's totals (0: no arc) and names of arcs (-1: none); and each state's sum over its arcs, with their
    number, by the bucket in the state's name (part -1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        hs = [np.cumsum(_unpack(b)) for b in pdf["h"]]
        ends = np.cumsum([len(x) for x in hs])[:-1]
        h, n = np.concatenate(hs), _joined(pdf["n"])
        w = ((bucket - _shift(h, buckets)) % buckets << 32) + _joined(pdf["w"])
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        total = np.add.reduceat(n[order], start)
        total[total < arc_least] = 0
        arc = total > 0
        name = np.where(arc, (bucket << 32) + np.cumsum(arc) - 1, -1)
        to = np.empty(len(order), np.int64)
        to[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
        rows = [(p, b, _pack_names(name[i]), _pack(total[i]), None) for p, b, i in zip(pdf["part"], pdf["bucket"], np.split(to, ends))]
        h, total = h[start][arc], total[arc]
        if len(h):
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            h, sums, arcs = h[first], np.add.reduceat(total, first), np.diff(np.r_[first, len(h)])
            rows += [(-1, b, _pack_names(h[i:j]), _pack(sums[i:j]), _pack(arcs[i:j])) for b, i, j in _slices(h >> 32)]
        _give_back()
        return pd.DataFrame(rows, columns=["part", "bucket", "name", "total", "arcs"])

    return run


def _masses(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket of states: for each part the sums over its states' arcs, and their numbers."""
    parts, sums = pdf[pdf["part"] >= 0], pdf[pdf["part"] < 0]
    names = [_names(b, 0) for b in parts["name"]]
    most = 2 + max([int(x.max(initial=-1)) for x in names], default=-1)
    total, arcs = np.zeros(most, np.int64), np.zeros(most, np.int64)  # the last is of what is no state
    for h, x, k in zip(sums["name"], sums["total"], sums["arcs"]):
        at = _names(h, 0)
        total[at] += _unpack(x)
        arcs[at] += _unpack(k)
    out = parts[["part", "bucket"]].copy()
    out["total"] = [_pack(total[x]) for x in names]
    out["arcs"] = [_pack(arcs[x]) for x in names]
    _give_back()
    return out


class Totals(NamedTuple):
    tokens: int
    distinct: int
    documents: int


def _walk(folder: str, totals: Totals, discount: float, buckets: int):
    """Scores a part's documents with the states and arcs that they can meet.

    The walk is of all the part's tokens at once. The state before a token is that of the last two words if they are an arc, else
    of the last word, else the root; a token takes the state's arc if there is one, and else the failure arcs down
    to a state that has it. Every state on that way adds its share.
    """

    def run(rows: pa.Table) -> pa.Table:
        pdf = rows.to_pandas().sort_values("bucket")
        number = int(pdf["part"].iloc[0])
        kind = {k: pdf[pdf["kind"] == k] for k in (1, 2, 3, -1, -2)}
        n1, n2, n3 = (_joined(kind[k]["total"]) for k in (1, 2, 3))
        mass1, mass2 = (_joined(kind[-k]["total"]) - discount * _joined(kind[-k]["arcs"]) for k in (1, 2))
        names = [_part_names(kind[k]) for k in (1, 2)]
        del rows, pdf, kind
        part = _part(folder, number)
        two, three = (x.taken for x in _taken(part, names, buckets))
        known = n1.copy()
        known[part.first] = 0
        root = np.log10((known + 1) / (totals.tokens + totals.distinct + 1))  # N + 1 * (V + 1)
        base = root[part.words]
        h = part.before()
        # From the last word's state: its failure arc's weight is what its arcs leave of its probability.
        p = (1 - mass1 / np.maximum(n1, 1))[h] * 10.0**base
        c = np.r_[n2, 0][two]
        p += np.where(c > 0, (c - discount) / np.maximum(n1[h], 1), 0)
        # From the state of the last two words.
        h[1:] = two[:-1]
        h[part.starts] = -1
        n, mass = np.r_[n2, 0][h], np.r_[mass2, 0.0][h]
        p *= 1 - mass / np.maximum(n, 1)
        c = np.r_[n3, 0][three]
        p += np.where(c > 0, (c - discount) / np.maximum(n, 1), 0)
        add = lambda x: np.add.reduceat(x, part.starts)
        columns = [part.ids, ~part.train, np.diff(part.ends, prepend=0), add((known[part.words] > 0).astype(np.int64)), np.full(len(part.ids), totals.tokens), add(base), add(np.log10(p))]
        out = pa.table([pa.array(c, k) for c, k in zip(columns, SCORES.types)], SCORES.names)
        _give_back()
        return out

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _give_back() -> None:
    """Returns freed memory to the system: a worker lives on and would hold its largest part's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def score_documents(spark: SparkSession, docs: DataFrame, least: int | None = None, arc_least: int = 2, discount: float = 0.75, part_bytes: int = 16 << 20) -> DataFrame:
    """Log10 probabilities of whole texts: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The automaton: the root has an arc for every word with the base's probability. Each word of ``least`` or more occurrences in
    training is a state, and so are the text's start and every pair of words that is an arc. By default ``least`` is
    ``arc_least``, at any size of corpus, and leaves nothing out: a rarer word can have no arc. A state h has an arc for each word
    w that follows it at least ``arc_least`` times in training, of probability (c(hw) - discount) / c(h) + back(h) * p(w at h's
    failure state); any other word takes its failure arc, of weight back(h) = 1 - sum over arcs of (c(hw) - discount) / c(h), from
    two words to the last one, and from that to the root. So each state's probabilities sum to 1. After a word the state is
    the longest of what was read last that is one.

    Words and steps are counted over all training documents; the tables grow with the corpus and are never broadcast.
    Documents are cut where they lie into parts of about ``part_bytes`` (one file each in the shared folder). A part's counts go out in
    packed slices, one for each bucket of words or steps; a bucket sums its slices and answers each in the slice's own order, so
    only numbers come back, and a task holds one part or one bucket, whatever the corpus. Three words are only asked for if both
    their pairs are arcs, which every arc of three words needs.

    Null texts are empty: one end token. Documents with a null id are learnt from. Repeated rows count and score as often as they
    occur. An empty table gives no rows. Other columns are not read.
    """
    folder = shared_folder(spark, "lm")
    least = arc_least if least is None else least
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("s")).collect()[0]["s"] or 0
    buckets = max(1, math.ceil(2 * size / part_bytes))

    def by(rows: DataFrame, key: str):
        return rows.repartition(buckets, key).groupBy(key)  # packed rows are small for the work they are: no fewer tasks

    counts = own.mapInArrow(_split(folder, part_bytes, buckets), "part long, bucket long, word binary, n binary")
    sums = ", ".join(f"{k} long" for k in Totals._fields)
    words = by(counts, "bucket").applyInPandas(_word_totals(least), f"part long, bucket long, total binary, name binary, {sums}")
    words = kept_table(words, f"{folder}/words")
    totals = Totals(*[x or 0 for x in words.agg(*[F.sum(k) for k in Totals._fields]).collect()[0]])

    nothing, states, rows, masses = F.lit(None).cast("binary"), words, [], []
    for order in (1, 2, 3):
        # What a part knows of its words, pairs and threes: totals and names.
        rows.append(states.where("part >= 0").select("part", "bucket", "name", "total", nothing.alias("arcs"), F.lit(order).alias("kind")))
        if order == 3:
            break
        names = reduce(DataFrame.unionByName, [r.select("part", "bucket", "name", "kind") for r in rows])
        steps = by(names, "part").applyInPandas(_steps(folder, buckets), "part long, bucket long, h binary, w binary, n binary")
        steps = by(steps, "bucket").applyInPandas(_step_totals(arc_least, buckets), "part long, bucket long, name binary, total binary, arcs binary")
        steps = kept_table(steps, f"{folder}/steps-{order + 1}")
        asked = rows[-1].select("part", "bucket", "name", nothing.alias("total"), nothing.alias("arcs")).unionByName(steps.where("part < 0"))
        masses.append(by(asked, "bucket").applyInPandas(_masses, "part long, bucket long, total binary, arcs binary").select("part", "bucket", nothing.alias("name"), "total", "arcs", F.lit(-order).alias("kind")))
        states = steps
    rows = reduce(DataFrame.unionByName, [*rows, *masses])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by(rows, "part").applyInArrow(_walk(folder, totals, discount, buckets), schema)
