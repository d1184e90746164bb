"""Operator 7: token ids in a content-addressed store: chunks cut by rolling hashes, recipes, Merkle manifest."""

from __future__ import annotations

import hashlib
import os
import re
import string
import uuid
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, kept_table, remove, shared_folder

KEPT = 400_000
WINDOW, LEAST, MOST, MASK = 4, 256, 8192, 1023
FAN = 256
_ODD = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # white space but space, tab and line ends
_PIECE = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_MARKS = string.punctuation.replace("'", "")  # an apostrophe may begin a unit with the letters after it


class _Words(dict):
    """Ids, as bytes, of words by their key; a word that is missing is encoded when it is asked for.

    Words of late, and those before them, which move up when they are met again; so a worker holds at most 2 * KEPT.
    """

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.encode(key)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Ids of a byte-level BPE file, as its library gives them for the whole text, words encoded once.

    The pattern that splits a text before merging never looks back, and always splits before white space that follows
    other characters. So a text can be cut there and each piece, white space and the word after it, encoded alone. Texts with
    white space other than space, tab and line ends, or with a special token's text, are encoded whole. Ids are kept
    as two bytes where the vocabulary allows it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; the library's own threads would spin on the few words of each call.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Words of letters are one unit of the byte-level pattern and can go to the model itself.
        plain = self.library.normalizer is None and type(self.library.pre_tokenizer).__name__ == "ByteLevel"
        self.model = self.library.model if plain else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.table = "".join(chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256))
        self.space = self.table[32]
        self.kept, self.ends = _Words(self._piece), _Words(self._whole)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str, lead: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(lead + shown)]).tobytes()

    def _piece(self, key: str) -> bytes:
        """A key that starts with white space is a piece as it is, one with "\x00" stands first; others follow one space."""
        core = key.rstrip(_MARKS)
        if self.model is not None and core.isalpha():
            if len(core) == len(key):
                return self._letters(key, self.space)
            return (dict.get(self.kept, core) or self._letters(core, self.space)) + self.ends[key[len(core) :]]
        first, rest = key[:1], key[1:]
        core = rest.rstrip(_MARKS)
        if self.model is not None and first in ("\x00", "\n") and core.isalpha():
            ids = self._letters(core, "")
            ids = self.ends["\n"] + ids if first == "\n" else ids
            return ids if len(core) == len(rest) else ids + self.ends[rest[len(core) :]]
        return self._whole(rest if first == "\x00" else key if first in ("\n", "\r", "\t", " ") else " " + key)

    def _plain(self, text: str) -> bool:
        """Whether words stand one space or one line's end apart, and nothing else has to be looked at."""
        if any(p in text for p in ("\x00", "  ", " \n", "\n ", "\n\n", "\t", "\r", *self.special)) or any(c in text for c in _ODD):
            return False
        return text[0] not in " \n" and text[-1] not in " \n"

    def _other(self, text: str) -> np.ndarray:
        if "\x00" in text or any(s in text for s in self.special) or any(c in text for c in _ODD):
            return np.frombuffer(self._whole(text), self.kind)
        # Keys are the pieces themselves; those of one space and a word are shared with plain texts.
        keys = [p[1:] if p[:1] == " " and p[1:2] not in ("", " ", "\n", "\r", "\t") else p if p[:1] in " \n\r\t" else "\x00" + p for p in _PIECE.findall(text)]
        return np.frombuffer(b"".join(map(self.kept.__getitem__, keys)), self.kind)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts. The words of all plain ones are told apart at once, so each is looked up but once."""
        out = [np.zeros(0, self.kind)] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and self._plain(t):
                plain.append(i)
            elif t:
                out[i] = self._other(t)
        if plain:
            lists = pc.split_pattern(pa.array(["\x00" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
            words = lists.flatten().dictionary_encode()
            found = list(map(self.kept.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
            ids, at = np.frombuffer(b"".join(found), self.kind), words.indices.to_numpy()
            long = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
            n = long[at]
            ends = np.cumsum(n)
            # The k-th id of a word comes from its own place and k.
            ids = ids[np.repeat((np.cumsum(long) - long)[at] - (ends - n), n) + np.arange(ends[-1])]
            stops = ends[lists.offsets.to_numpy()[1:] - 1]
            for i, x in zip(plain, np.split(ids, stops[:-1])):
                out[i] = x
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# A number for each id and each place in the window.
_GEAR = np.random.default_rng(7).integers(0, 2**32, (WINDOW, 1 << 16), np.uint32)


def _marks(ids: np.ndarray) -> np.ndarray:
    """Places after ids where a hash rolling over the last WINDOW of them has its low bits 0."""
    low = ids if ids.dtype.itemsize == 2 else ids & 0xFFFF
    h = _GEAR[0][low]
    for i in range(1, WINDOW):
        h[i:] += _GEAR[i][low[: len(low) - i]]
    return np.flatnonzero(h & np.uint32(MASK) == 0) + 1


def _stops(marks: np.ndarray, n: int) -> list[int]:
    """Ends of a stream's chunks: at marks, LEAST to MOST ids apart."""
    out, last = [], 0
    while n - last > LEAST:
        i = np.searchsorted(marks, last + LEAST)
        at = min(int(marks[i]) if i < len(marks) else n, last + MOST)
        if at >= n:
            break
        out.append(at)
        last = at
    return [*out, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream of ids; they depend on the ids near them alone."""
    return _stops(_marks(ids), len(ids))


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


REFS = "array<struct<digest:binary,pack:string,at:bigint,length:int,n:int>>"
_REF = {"digest": pa.binary(), "pack": pa.string(), "at": pa.int64(), "length": pa.int32(), "n": pa.int32()}
KNOWN = 200_000  # chunks or texts that a task remembers; beyond them it stores one again, and the index finds that


def _few(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    """Texts of about ``most`` characters at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _encode(path: str, folder: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        e, z = encoder(path), zstandard.ZstdCompressor(level=1)
        last_id = np.array([end], e.kind)
        width = last_id.itemsize
        fs, top = filesystem(folder)
        pack, out, at = f"{uuid.uuid4().hex}.pack", None, 0
        known: dict[bytes, tuple[int, int]] = {}
        texts: dict[bytes, tuple[int, list]] = {}
        for batch in batches:
            n, ends, refs = [], [0], []
            for some in _few(batch.column(1).to_pylist()):
                digests = [_digest((t or "").encode("utf-8", "surrogatepass")) for t in some]
                if len(texts) > KNOWN // 4:
                    texts.clear()
                new = {d: t for d, t in zip(digests, some) if d not in texts}
                found = [np.append(x, last_id) for x in e.encode_many(list(new.values()))]
                # Marks before the first LEAST ids of a text are not used, so all texts' marks can be found at once.
                marks, start = _marks(np.concatenate(found)) if found else None, 0
                for own, ids in zip(new, found):
                    stop = start + len(ids)
                    i, j = np.searchsorted(marks, (start + LEAST, stop))
                    raw, last, chunks = ids.tobytes(), 0, []
                    for at_id in _stops(marks[i:j] - start, len(ids)):
                        piece = raw[last * width : at_id * width]
                        d = _digest(piece)
                        if d not in known:
                            out = out or fs.open_output_stream(f"{top}/{pack}", compression=None)
                            packed = z.compress(piece)
                            out.write(packed)
                            if len(known) > KNOWN:
                                known.clear()
                            known[d], at = (at, len(packed)), at + len(packed)
                        chunks.append((d, pack, *known[d], at_id - last))
                        last = at_id
                    texts[own], start = (len(ids), chunks), stop
                for d in digests:
                    length, chunks = texts[d]
                    n.append(length)
                    refs += chunks
                    ends.append(len(refs))
            columns = [pa.array(c, k) for c, k in zip(zip(*refs) if refs else [()] * 5, _REF.values())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(_REF)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists], ["doc_id", "n_tokens", "refs"])
        if out:
            out.close()

    return run


def _repack(old: str, new: str):
    """Copies the chunks that stay, in order, from the packs of each task to packs without the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, source), (_, top) = filesystem(old), filesystem(new)
        name, read, at, out, to = "", None, 0, None, f"{uuid.uuid4().hex}.pack"
        for batch in batches:
            places = []
            for pack, start, length in zip(*(batch.column(c).to_pylist() for c in ("pack", "at", "length"))):
                if pack != name:
                    name, read = pack, fs.open_input_file(f"{source}/{pack}")
                out = out or fs.open_output_stream(f"{top}/{to}", compression=None)
                out.write(read.read_at(length, start))
                places.append(at)
                at += length
            columns = [batch.column("digest"), pa.array([to] * len(places), pa.string()), pa.array(places, pa.int64()), batch.column("length"), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, list(_REF))
        if out:
            out.close()

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of ids and of recipes before each, in its partition."""
    from pyspark import TaskContext

    part, ids, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        before = np.cumsum(n) - n + ids
        ids, place, rows = ids + int(n.sum()), np.arange(rows, rows + len(n)), rows + len(n)
        added = {"part": pa.array(np.full(len(n), part, np.int32)), "start": pa.array(before.astype(np.int64)), "place": pa.array(place.astype(np.int64))}
        yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


class Store(NamedTuple):
    """``folder`` holds the packs; ``recipes`` (doc_id, start, place, n_tokens, refs, leaf), in ascending doc_id order; ``index``
    of unique chunks; ``root``: the Merkle root over the recipes' leaves."""

    folder: str
    recipes: DataFrame
    index: DataFrame
    root: str


def merkle_root(leaves: DataFrame) -> str:
    """The root over ``leaves(place, leaf)``: FAN children at a time, as many levels as it takes; of none, the empty hash."""
    level = leaves
    while True:
        rows = level.limit(2).collect()
        if len(rows) < 2:
            return rows[0]["leaf"] if rows else hashlib.sha256(b"").hexdigest()
        kids = F.array_sort(F.collect_list(F.struct("place", "leaf")))
        joined = F.concat_ws("", F.transform(kids, lambda x: x["leaf"]))
        level = cut(level.groupBy(F.floor(F.col("place") / FAN).alias("place")).agg(F.sha2(joined, 256).alias("leaf")))


def _leaf() -> Column:
    # A recipe's hash: its id, length and chunk digests in order.
    digests = F.concat_ws(",", F.transform("refs", lambda r: F.hex(r["digest"])))
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens").cast("string"), digests), 256)


def write_ids(spark: SparkSession, docs: DataFrame, path: str, end: int, part_rows: int = 20_000, most_parts: int = 4096) -> Store:
    """Encodes every whole text, appends ``end`` to each, and writes the ids to a content-addressed store.

    1. Where the documents lie, each task encodes them, cuts each document's ids into chunks by a rolling hash, and appends
       chunks that it has not stored yet to a pack file of its own, by Zstandard. Ids of vocabularies up to 65,536 take two bytes.
       A text that the task has met lately gets that one's chunks and is not encoded again.
    2. The chunk index keeps one place for each digest. Packs are copied without what another pack has, so every unique
       chunk is stored once; no payload is shuffled.
    3. A document's recipe lists its chunks' digests and places. Recipes lie in ascending doc_id order, in ranges of about ``part_rows`` (more in each if there are over
       ``most_parts``), with
       the number of ids before each; a Merkle tree over them has one root, the manifest.

    Null and empty texts have the end id alone. Repeated ids are documents of their own, in no particular order among
    themselves; null ids come first. An empty table gives an empty store. Extra columns are not read. Ids never leave Arrow, so they are exact.
    """
    folder = shared_folder(spark, "ids")
    raw, packs = f"{folder}/raw", f"{folder}/packs"
    for f in (raw, packs):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, raw, end), f"doc_id long, n_tokens long, refs {REFS}")
    rows = kept_table(rows.withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
    refs = rows.select("row", "doc_id", "n_tokens", F.posexplode("refs").alias("k", "r")).select("row", "doc_id", "n_tokens", "k", "r.*")
    one = refs.groupBy("digest").agg(F.min(F.struct("pack", "at", "length", "n")).alias("p")).select("digest", "p.*")
    index = one.repartition("pack").sortWithinPartitions("pack", "at").mapInArrow(_repack(raw, packs), "digest binary, pack string, at long, length int, n int")
    index = kept_table(index, f"{folder}/index")
    remove(spark, raw)

    placed = refs.select("row", "doc_id", "n_tokens", "k", "digest").join(index, "digest")
    own = placed.groupBy("row", "doc_id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "pack", "at", "length", "n"))).alias("refs"))
    own = own.withColumn("refs", F.expr("transform(refs, r -> named_struct('digest', r.digest, 'pack', r.pack, 'at', r.at, 'length', r.length, 'n', r.n))"))
    parts = min(most_parts, max(1, -(-rows.count() // part_rows)))
    own = own.withColumn("leaf", _leaf()).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    own = own.mapInArrow(_running, f"doc_id long, n_tokens long, refs {REFS}, leaf string, part int, start long, place long")
    own = kept_table(own, f"{folder}/recipes")
    # A row for each range: what the ranges before it hold.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("rows"))
    base = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("ids", "rows")])
    recipes = own.join(F.broadcast(base), "part").select("doc_id", (F.col("start") + F.col("ids")).alias("start"), (F.col("place") + F.col("rows")).alias("place"), "n_tokens", "refs", "leaf")
    return Store(folder, recipes, index, merkle_root(recipes.select("place", "leaf")))


def _fetch(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, top = filesystem(f"{folder}/packs")
        z, files, cache = zstandard.ZstdDecompressor(), {}, {}
        for batch in batches:
            lists = batch.column("refs")
            flat = lists.flatten()
            digests, packs, ats, lengths = (flat.field(c).to_pylist() for c in ("digest", "pack", "at", "length"))
            out, i = [], 0
            for n in pc.list_value_length(lists).to_pylist():
                ids = []
                for i in range(i, i + n):
                    d = digests[i]
                    if d not in cache:
                        if packs[i] not in files:
                            if len(files) >= 64:
                                files.clear()
                            files[packs[i]] = fs.open_input_file(f"{top}/{packs[i]}")
                        raw = z.decompress(files[packs[i]].read_at(lengths[i], ats[i]))
                        if _digest(raw) != d:
                            raise ValueError(f"a chunk of {packs[i]} does not have its digest")
                        if len(cache) >= 2000:
                            cache.clear()
                        cache[d] = raw
                    ids.append(cache[d])
                i += n > 0
                out.append(np.frombuffer(b"".join(ids), kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_ids(store: Store, kind: str = "<u2", verify: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ids as little-endian unsigned 32-bit integers, put together from the packs.

    Each chunk is checked against its digest, and with ``verify`` the recipes against the manifest's root.
    """
    if verify and merkle_root(store.recipes.select("place", _leaf().alias("leaf"))) != store.root:
        raise ValueError("the recipes do not have the manifest's root")
    return store.recipes.select("doc_id", "start", "n_tokens", "refs").mapInArrow(_fetch(store.folder, kind), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end: int) -> DataFrame:
    """What the store gives back: ``doc_id, start, n_tokens, ids_crc32``, counted and summed over the ids that were read."""
    ids = read_ids(write_ids(spark, docs, path, end), encoder(path).kind)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
