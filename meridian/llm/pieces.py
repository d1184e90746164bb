"""Operator 1: SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, with_column

SPACE = "▁"
KEPT = 300_000


class Trie:
    """A double-array trie over bytes: the child of s by byte c is base[s] + c + 1, if check[] there is s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for k, v in keys.items():
            at = tree
            for c in k:
                at = at.setdefault(c + 1, {})
            at[0] = v
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], free, wide, queue = 0, 258, 258, [(0, tree)]
        while queue:
            s, node = queue.pop()
            value[s] = node.pop(0, -1)
            if not node:
                continue
            codes = sorted(node)
            # Single children fill the holes; the others look from ``wide`` on, which leaves crowded stretches behind.
            b, tries = max(0, (free if len(codes) == 1 else wide) - codes[0]), 0
            while True:
                while b + 258 > len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[b + c] < 0 for c in codes):
                    break
                b, tries = b + 1, tries + 1
            if len(codes) > 1 and tries > 16:
                wide = b + codes[0]
            base[s] = b
            for c in codes:
                check[b + c] = s
                queue.append((b + c, node[c]))
            while free < len(check) and check[free] >= 0:
                free += 1
        base += [0] * 258  # so that no byte leads outside
        check += [-1] * 258
        value += [-1] * 258
        self.base, self.check, self.value = base, check, value

    def prefixes(self, raw: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that begins at ``start``."""
        base, check, value, s = self.base, self.check, self.value, 0
        for i in range(start, len(raw)):
            t = base[s] + raw[i] + 1
            if check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class Unigram:
    """A unigram model over the pieces of a public SentencePiece file.

    The file has merge ranks, no probabilities, and tokenizers are not trained here; so a piece of rank r has the log score
    of Zipf's law, -ln((r + 1) * H). Pieces without a rank come last. A character that no piece of its own covers costs as
    much as the worst piece and 10 more, and becomes one byte piece for each byte.
    """

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces to fall back to")
        whole = math.log(sum(1 / (r + 1) for r in range(n)))
        own = {i: self.pieces[i] for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        self.score = {i: -math.log(min(n, -p.get_score(i)) + 1) - whole for i in own}
        self.unknown = min(self.score.values()) - 10
        self.trie = Trie({s.encode(): i for i, s in own.items()})
        self.scores = [self.score.get(i, 0.0) for i in range(n)]
        self.raw = [s.replace(SPACE, " ").encode() for s in self.pieces]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        # Words can be encoded apart if no piece crosses into the next word's mark or a line's end.
        self.apart = not any(SPACE in s.lstrip(SPACE) or "\n" in s for s in own.values())
        self.kept: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation; of equal ones that with the longer piece at its end."""
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for i in range(n):
            if best[i] == -math.inf:
                continue
            here, s, j = best[i], 0, i
            c = raw[i]
            char = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            single = False
            while j < n:
                t = base[s] + raw[j] + 1
                if check[t] != s:
                    break
                s, j = t, j + 1
                v = value[s]
                if v >= 0:
                    single = single or j == char
                    if here + scores[v] > best[j]:
                        best[j], back[j] = here + scores[v], (i, v)
            if not single and here + self.unknown > best[char]:
                best[char], back[char] = here + self.unknown, (i, -1)
        out, j = [], n
        while j:
            i, v = back[j]
            out += [v] if v >= 0 else [self.byte[b] for b in reversed(raw[i:j])]
            j = i
        return out[::-1]

    def _word(self, key: str) -> bytes:
        """Ids, as bytes, of a word by its key: without its own mark, or with \\x01 before a line's end that has none."""
        text = key[1:] if key[:1] == "\x01" else SPACE + key.replace(" ", SPACE)
        return np.array(self.viterbi(text), "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        """``text`` begins with a space or is empty, and has no mark of its own."""
        if not self.apart or "\x01" in text:
            return np.array(self.viterbi(text.replace(" ", SPACE)), "<u4").tobytes()
        if "  " in text or " \n" in text:
            keys = [k[1:] for k in re.findall(" +[^ ]*", text)]
        else:
            keys = text.replace("\n", " \x01\n").split(" ")[1:]
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        for k in [k for k in set(keys) if k not in kept]:
            kept[k] = self._word(k)
        return b"".join(map(kept.__getitem__, keys))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text. One mark is put before it; a mark that the text itself has goes to byte pieces."""
        if not text:
            return np.zeros(0, "<u4")
        first, *rest = text.split(SPACE)
        out = self._part(" " + first)
        own = np.array([self.byte[b] for b in SPACE.encode()], "<u4").tobytes()
        for part in rest:
            # What follows such a mark has no mark of its own, unless it begins with a space.
            head, sep, tail = part.partition(" ")
            out += own + np.array(self.viterbi(head), "<u4").tobytes() + (self._part(sep + tail) if sep else b"")
        return np.frombuffer(out, "<u4")

    def decode(self, ids) -> str:
        """The text of ids: byte pieces become bytes, marks spaces, and the mark put before the text goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    """One model for each Python worker and path; every executor has the vocabulary files at the same place."""
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids array<int>``, in place of a column of that name. Null and empty texts have no ids. All columns and rows stay."""
    docs = docs.drop("piece_ids")
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("piece_ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                few = batch.slice(i, 512)
                ids = [m.encode(t).astype(np.int32) for t in few.column(text).to_pylist()]
                yield with_column(few, "piece_ids", pa.array(ids, pa.list_(pa.int32())))

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with ``decoded string``, in place of a column of that name; null ids decode to null."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(None).cast("string").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if x is None else m.decode(x) for x in batch.column(ids).to_pylist()]
            yield with_column(batch, "decoded", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, schema)


_CHECKED = {"doc_id": pa.int64(), "n_chars_in": pa.int64(), "n_pieces": pa.int64(), "n_byte_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded_crc32": pa.int64(), "exact": pa.bool_()}


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Each whole text encoded and decoded in one pass: ``doc_id, n_chars_in, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, exact``.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers. ``exact``: decoding gave the text back; a null text
    counts as empty. One row for each row of ``docs``, those of null or repeated ids too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        low, high = min(m.byte.values()), max(m.byte.values())
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                ids, t = m.encode(t), t or ""
                back = m.decode(ids.tolist())
                out.append((len(t), len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == t))
            yield beside(batch.column("doc_id"), out, _CHECKED)

    schema = "doc_id long, n_chars_in long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, exact boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
