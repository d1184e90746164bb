"""Operator 3: SimHash fingerprints, linked through a multi-index of fingerprint halves."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, grouped, in_blocks, in_slices, kept_table, roots_of, shared_folder, spanning

BLOCK, WIDE_BLOCK = 64, 1024


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is set in over half the XXH64 of its word shingles.

    A-Z are lower-cased, words are split at ASCII white space, shingles keep repeats. Fewer words than ``words`` make one
    shingle; none make fingerprint 0. Long texts are hashed in slices, whole.
    """
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, in both steps
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest, counts = partial(xxhash.xxh64_intdigest, seed=seed), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        m = min(n - i, 1 << 16)
        shingles = map(b" ".join, zip(*(w[i + k : i + k + m] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.array(list(map(digest, shingles)), ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fp``: fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _linked(most: int):
    """Of whole groups of fingerprints: edges of a spanning forest of those at ``most`` or fewer differing bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, rep, table = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), pdf["kind"].to_numpy() == 0
        g = pdf.groupby(["seg", "code", "pair"], sort=False).ngroup().to_numpy()
        a, b = [], []
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        step, longest = 1, int(np.diff(np.r_[start, len(g)]).max())
        while step < longest:
            i = np.flatnonzero(g[step:] == g[:-step])
            i = i[(table[i] | table[i + step]) & (np.bitwise_count(fp[i] ^ fp[i + step]) <= most)]
            a.append(i)
            b.append(i + step)
            step += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        # Components over the fingerprints themselves: one may stand in several groups.
        node, at = np.unique(rep, return_inverse=True)
        x, y = spanning(node, node[roots_of(len(node), at[a], at[b])])
        return pd.DataFrame({"a": x, "b": y})

    return run


def links(reps: DataFrame, most: int = 3) -> DataFrame:
    """Edges ``a, b`` that connect ``reps(fp, rep)`` wherever two fingerprints differ in ``most`` (3) or fewer bits.

    Two fingerprints at distance 3 or less are at distance 1 or less in one of their halves. So each half's table has
    every fingerprint, and each fingerprint looks up the ball of radius 1 around its half. Of two halves that differ in a
    bit one has a 0 there, so setting bits that are 0 finds every such pair. What the lookups fetch is compared in full.
    """
    if not 0 <= most <= 3:
        raise ValueError("halves with balls of radius 1 find distances up to 3")
    half = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", 32 * (1 - s)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("code")) for s in (0, 1)]))
    table = reps.select("fp", "rep", half.alias("h")).select("fp", "rep", "h.seg", "h.code", F.lit(0).alias("kind"))
    bits = F.explode(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]))
    ball = table.select("fp", "rep", "seg", "code", bits.alias("bit")).where(F.col("code").bitwiseAND(F.col("bit")) == 0)
    ball = ball.select("fp", "rep", "seg", F.col("code").bitwiseOR(F.col("bit")).alias("code"), F.lit(1).alias("kind"))
    keys = table.select("seg", "code").distinct()
    rows = cut(table.unionByName(ball.join(keys, ["seg", "code"], "left_semi")))
    pairs = in_blocks(rows, ["seg", "code"], F.xxhash64("fp"), BLOCK)
    return grouped(pairs, ["seg", "code", "pair"], _linked(most), "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    component_id is the smallest doc_id reachable through fingerprints at ``most`` or fewer differing bits, the document
    itself included. Equal fingerprints are one node, so thousands of copies cost one lookup. Null, empty and
    blank texts have fingerprint zero and are linked as any other. Repeated rows come out as often as they went in;
    rows with a null id get a null component unless their fingerprint is linked. An empty table gives no rows; other
    columns are not read.
    """
    fps = cut(fingerprints(docs, text, key))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(reps.where("rep is not null"), most))
    known = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    known = cut(known)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(known, "fp").select("doc_id", hexed, "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 of a whole text's word shingles, sorted; a text of fewer words is one shingle, of none has none."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.array(list(map(partial(xxhash.xxh64_intdigest, seed=42), shingles)), np.uint64))


def wide_fingerprint(hashes: np.ndarray, longs: int = 7) -> np.ndarray:
    """A SimHash of 64 * ``longs`` bits: each long takes the majority of another mix of the same hashes. The share of differing bits tells the cosine, so the Jaccard similarity, of two sets."""
    counts, n = np.zeros((longs, 64), np.int64), len(hashes)
    for i in range(0, n, 1 << 14):
        z = hashes[i : i + (1 << 14), None] + (np.arange(longs, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums that fit in a byte are fast
            counts += bits[j : j + 255].sum(0, dtype=np.uint8).reshape(longs, 64)
    return np.packbits((counts * 2 > n).reshape(-1), bitorder="little").view(np.uint64)


def forest(n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the links a-b make up a spanning forest of least cost; ties go to the earlier one."""
    live = np.argsort(cost, kind="stable")
    root, chosen = np.arange(n), []
    while len(live := live[root[a[live]] != root[b[live]]]):
        first = np.full(n, len(live))
        for end in (a, b):
            np.minimum.at(first, root[end[live]], np.arange(len(live)))
        chosen.append(live[np.unique(first[first < len(live)])])
        kept = np.concatenate(chosen)
        root = roots_of(n, a[kept], b[kept])
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _balls(half: int):
    """Of whole groups of segments that agree in one half: what each one's ball of radius 1 meets in the table, and the table's entries that are met.

    Column k has the segment's number, the side (0: by the upper half), the division and the half, r the other half and whether the segment
    looks up (it stands in a neighbouring division else). Entries are named alike on both sides.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, r, node = (pdf[c].to_numpy() for c in ("k", "r", "node"))
        rest, mine = (r >> 1).astype(np.int64), (r & 1).astype(bool)
        side, division, same = (k >> 40) & 1, (k & (1 << 40) - 1) >> half, k & (1 << half) - 1
        group = np.cumsum(np.r_[0, k[1:] != k[:-1]]).astype(np.int64)
        code, one, at, n = np.unique((group << half) + rest, return_index=True, return_inverse=True, return_counts=True)
        # Equal segments meet on one side only, and where one of them is at home; that side names the entries for both.
        equal = (n > 1) & (np.bincount(at, mine, len(code)) > 0)
        active = equal & (side[one] == 0)
        to, who = [], []
        for bit in range(half):
            i = np.flatnonzero(mine & (rest >> bit & 1 == 0))  # of two that differ in a bit one has a 0 there
            want = code[at[i]] + (1 << bit)
            j = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = code[j] == want
            to.append(j[hit])
            who.append(node[i[hit]])
        to, who = np.concatenate(to), np.concatenate(who)
        active[to] = True
        active &= ~(equal & (side[one] == 1))
        there = np.flatnonzero(active[at])
        whole = np.where(side == 0, (same << half) + rest, (rest << half) + same)
        names = ((((k >> 41) << 16) + division) << 2 * half) + whole
        kinds = np.r_[np.zeros(len(there), np.int32), np.ones(len(to), np.int32)]
        return pd.DataFrame({"code": np.r_[names[there], names[one[to]]], "node": np.r_[node[there], who], "kind": kinds})

    return run


def first_segment(x: np.ndarray, segment: int) -> np.ndarray:
    """The number of the first segment that holds one bit or none of ``x``, the differing bits of pairs of wide fingerprints."""
    count = 64 * x.shape[1] // segment
    first = np.full(len(x), count)
    for s in reversed(range(count)):
        at, off = divmod(s * segment, 64)
        c = x[:, at] >> np.uint64(off)
        if off + segment > 64:
            c = c | x[:, at + 1] << np.uint64(64 - off)
        first[np.bitwise_count(c & np.uint64((1 << segment) - 1)) <= 1] = s
    return first


def _nearest(most: int, segment: int, forests: int | None = 1, reach: int | None = None):
    """Of whole groups of wide fingerprints: spanning forests, closest pairs first, of those at ``most`` or fewer differing bits.

    Nodes of one ``root`` are in one group already and count as one; pairs of a node with those in its ``refused`` are left out, and so are
    pairs that an earlier segment has. Each of the ``forests`` is of the pairs that the ones before have left, at ``reach`` or fewer bits; None:
    all pairs. Bit 0 of ``kind`` marks lookups, which meet entries alone, bit 1 a group of two blocks, and the rest is the block. Pairs within one of two
    blocks are the business of the block's own group, so here they only spare links. Rows with a code have no link but
    a group's ``nodes`` and ``kinds`` that are in pairs yet untried.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of, kind, code = (pdf[c].to_numpy() for c in ("node", "kind", "code"))
        node, one, at = np.unique(of, return_index=True, return_inverse=True)
        _, root = np.unique(pdf["root"].to_numpy()[one], return_inverse=True)
        refused = pdf["refused"].iloc[one].to_list()
        owner, other = np.repeat(np.arange(len(node)), [len(x) for x in refused]), np.concatenate([np.asarray(x, np.int64) for x in refused])
        place = np.minimum(np.searchsorted(node, other), len(node) - 1)
        there = node[place] == other
        out = owner[there] * len(node) + place[there]
        fp, table, crossed = np.stack(pdf["fp"].to_list()).astype(np.int64).view(np.uint64), kind & 1 == 0, kind & 2 > 0
        g, part = pdf.groupby(["code", "pair"], sort=False).ngroup().to_numpy(), code >> (segment + 16)
        a, b, d = [], [], []
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for step in range(1, int(np.diff(np.r_[start, len(g)]).max())):
            i = np.flatnonzero(g[step:] == g[:-step])
            i = i[(table[i] | table[i + step]) & (root[at[i]] != root[at[i + step]])]
            x = fp[i] ^ fp[i + step]
            bits = np.bitwise_count(x).sum(1, dtype=np.int64)
            near = np.flatnonzero(bits <= most)
            near = near[first_segment(x[near], segment) == part[i[near]]]
            a.append(i[near])
            b.append(i[near] + step)
            d.append(bits[near])
        a, b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, d))
        inner = crossed[a] & (kind[a] >> 2 == kind[b] >> 2)
        order = np.argsort(inner, kind="stable")  # where a block's own group is here too, the pair is tried there
        a, b, d, inner = a[order], b[order], d[order], inner[order]
        pair, first = np.unique(np.minimum(at[a], at[b]) * len(node) + np.maximum(at[a], at[b]), return_index=True)
        first = first[~np.isin(pair, out)]
        a, b, d, inner = a[first], b[first], d[first], inner[first]
        x, y, cost, far = at[a], at[b], np.where(inner, d - 64 * fp.shape[1], d), most if reach is None else reach
        kept, left = [], np.flatnonzero(~inner)
        if forests is None:
            kept, left = [left], left[:0]
        for _ in range(forests or 0):
            some = np.flatnonzero(inner & (d <= far))
            some = np.r_[some, left[d[left] <= far]]
            some = some[forest(len(root), root[x[some]], root[y[some]], cost[some])]
            some = some[~inner[some]]
            kept.append(some)
            left = np.setdiff1d(left, some)
            if not len(left) or not len(some):
                break
        kept, row = np.concatenate(kept), np.unique(np.r_[a[left], b[left]])
        found = pd.DataFrame({"a": node[np.minimum(x[kept], y[kept])], "b": node[np.maximum(x[kept], y[kept])], "code": -1, "pair": 0})
        found = found.assign(**{c: pd.Series([[]] * len(kept), dtype=object) for c in ("nodes", "kinds")})
        if not len(row):
            return found
        begin = np.flatnonzero(np.r_[True, g[row][1:] != g[row][:-1]])
        rest = pd.DataFrame({"a": -1, "b": -1, "code": code[row[begin]], "pair": pdf["pair"].to_numpy()[row[begin]], "nodes": pd.Series(np.split(of[row], begin[1:]), dtype=object), "kinds": pd.Series(np.split(kind[row], begin[1:]), dtype=object)})
        return pd.concat([found, rest]) if len(found) else rest

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, longs: int = 7, segment: int = 24, margin: float = 0.05, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, digest, first_id, first_digest``: each distinct document (an id and the MD5 of its text) with the first one of its group.

    Documents are linked where the sets of their shingles of ``words`` words have a Jaccard similarity of ``least`` or more.

    1. Equal sets are one class. A class has a fingerprint of 64 * ``longs`` bits, cut in segments of ``segment`` bits.
    2. Each segment's table has every fingerprint; each fingerprint looks up the ball of radius 1 around its segment. A ball is
       looked up where its table is: a segment goes out twice, by its upper and its lower half, and the other half's bits are
       changed there. Sets can only be similar if their sizes are, so a table is divided by the size's logarithm: a
       fingerprint lies in its own division and the nearer neighbour and looks up its own.
    3. Of what a lookup fetches the complete distance is taken. Candidates are pairs within the distance that ``least`` is expected at, and
       ``margin`` of all bits more. They make up a spanning forest, closest pairs first, so groups of near copies send as many links as documents.
    4. The forest's pairs are checked exactly, on their sets (of 32-bit halves of the hashes). Where one is refused, another candidate may
       still join its ends' groups: sixteen forests follow, then all that is left, of the candidates between what is apart, but for those
       refused. So the groups are the components of all candidates that pass, at any numbering and dealing of rows.

    At a similarity of just 0.8 one pair in about seven meets in no segment, at 0.85 one in 25, at 0.9 one in 300. The first document is
    the one with the smallest id, then digest; null ids come last. Null, empty and blank texts are one class. Repeated rows
    come out once. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n, fps, sets, kinds = [], [], [], []
            for t in batch.column("t").to_pylist():
                h = shingle_hashes(t, words)
                n.append(len(h))
                fps.append(wide_fingerprint(h, longs).view(np.int64))
                sets.append(np.unique(h.astype(np.uint32)).tobytes())
                kinds.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(kinds, pa.binary()), pa.array(n, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "digest", "kind", "n", "fp", "shingles"])

    folder = shared_folder(docs.sparkSession, "near")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(text).alias("digest"), F.col(text).alias("t"))
    rows = kept_table(own.mapInArrow(run, "doc_id long, digest string, kind binary, n long, fp array<long>, shingles binary"), f"{folder}/rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    classes = rows.groupBy("kind").agg(F.min(first).alias("top"), F.max("n").alias("n"), F.max("fp").alias("fp"))
    classes = kept_table(classes.withColumn("node", F.monotonically_increasing_id()), f"{folder}/classes")

    some = classes.where("n > 0").select("node", "n", "fp")
    # Segments are cut from the fingerprint's longs in the JVM.
    count, half = 64 * longs // segment, segment // 2
    cells = []
    for s in range(count):
        at, off = divmod(s * segment, 64)
        low = F.shiftrightunsigned(F.col("fp")[at], off)
        if off + segment > 64:
            low = low.bitwiseOR(F.shiftleft(F.col("fp")[at + 1], 64 - off))
        c = low.bitwiseAND(F.lit((1 << segment) - 1))
        upper, lower = F.shiftright(c, half), c.bitwiseAND(F.lit((1 << half) - 1))
        for side, (key_half, rest) in enumerate(((upper, lower), (lower, upper))):
            for mine, division in ((1, "own"), (0, "next")):
                k = F.shiftleft(F.lit(2 * s + side).cast("long"), 40) + F.shiftleft((F.col(division) + 1).cast("long"), half) + key_half
                cells.append(F.struct(k.alias("k"), (rest * 2 + mine).cast("int").alias("r")))
    size = F.log(F.col("n").cast("double")) / (2 * math.log(1 / least))
    divided = some.select("node", "fp", F.floor(size).alias("own"), (F.floor(size) + F.when(size - F.floor(size) < 0.5, -1).otherwise(1)).alias("next"))
    cells = divided.select("node", F.explode(F.array(*cells)).alias("cell")).select("cell.*", "node")
    met = cut(grouped(cells, ["k"], _balls(half), "code long, node long, kind int").distinct())
    cosine = 2 * least / (1 + least)
    most = int(64 * longs * (math.acos(cosine) / math.pi + margin))

    def untried(pairs: DataFrame, forests: int | None, reach: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Links to be checked, and the pairs' rows that are in others yet."""
        found = cut(grouped(pairs, ["code", "pair"], _nearest(most, segment, forests, reach), "a long, b long, code long, pair int, nodes array<long>, kinds array<int>"))
        rest = found.where("code >= 0").select("code", "pair", F.explode(F.arrays_zip("nodes", "kinds")).alias("row"))
        return found.where("code < 0").select("a", "b").distinct(), cut(rest.select("code", "pair", F.col("row.kinds").alias("kind"), F.col("row.nodes").alias("node")))

    def tried(links: DataFrame) -> DataFrame:
        sided = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
        sided = sided.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
        return cut(sided.select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long, ok boolean"))

    none = F.array().cast("array<long>")
    kind = F.col("kind") + F.when(F.col("own"), 0).otherwise(2) + F.col("b") * 4
    pairs = in_blocks(met, ["code"], F.xxhash64("node"), WIDE_BLOCK).select("node", F.struct("code", "pair", kind.alias("kind")).alias("cell"))
    # A node meets others in many places, so what is known of it joins its list of them.
    places = pairs.groupBy("node").agg(F.collect_list("cell").alias("cells")).join(some.select("node", "fp").hint("merge"), "node")
    pairs = places.select(F.explode("cells").alias("cell"), "node", "fp", F.col("node").alias("root"), none.alias("refused")).select("cell.*", "node", "fp", "root", "refused")
    links, rest = untried(pairs, 1, int(64 * longs * math.acos(cosine) / math.pi))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).unionByName(rest.select("node")).distinct()
    ends = classes.select("node", "kind").join(ends.hint("merge"), "node", "left_semi")
    sets = kept_table(rows.select("kind", "shingles").join(ends.hint("merge"), "kind").dropDuplicates(["node"]).select("node", "shingles"), f"{folder}/sets")
    done = tried(links)
    groups, refused, forests = components(done.where("ok")), done.where("not ok"), 16
    while not rest.isEmpty():
        state = some.select("node", "fp").join(rest.select("node").distinct().hint("merge"), "node", "left_semi")
        state = state.join(groups.hint("merge"), "node", "left").select("node", "fp", F.coalesce("component", "node").alias("root"))
        without = refused.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refused"))
        state = cut(state.join(without.hint("merge"), "node", "left").select("node", "fp", "root", F.coalesce("refused", none).alias("refused")))
        links, rest = untried(rest.join(state.hint("merge"), "node").select("code", "pair", "kind", "node", "fp", "root", "refused"), forests)
        done, forests = tried(links), None
        refused = refused.unionByName(done.where("not ok"))
        if not done.where("ok").isEmpty():
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(done.where("ok").select("a", "b")))
    known = classes.select("node", "kind", "top").join(groups.hint("merge"), "node", "left").withColumn("group", F.coalesce("component", "node"))
    best = cut(known.groupBy("group").agg(F.min("top").alias("first")))
    known = cut(known.join(best.hint("merge"), "group").select("kind", "first"))
    return rows.select("doc_id", "digest", "kind").distinct().join(known, "kind").select("doc_id", "digest", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))


def text_digest(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))

