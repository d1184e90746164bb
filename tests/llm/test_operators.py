"""Each operator against a plain version on small tables, and on odd rows: nulls, empty and long texts, repeats, clashing names."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import idstore, lm, mixing, pieces, quality, registry, sharding, simhash, topk, vectors, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
BASE = "the quick brown fox jumps over the lazy dog and then some more words follow here until the line ends well past any doubt at all "


def odd_rows():
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(30000))
    near = (BASE * 30).split()
    out = [(0, None, "en", None), (1, "", "en", "a"), (2, "  \n\t ", None, "a"), (3, long, "en", "b"), (4, BASE * 30, "en", "b"), (5, BASE * 30, "en", "b"), (6, " ".join([*near[:-1], "changed"]), "fr", "é"), (7, "One Two", "en", "c"), (8, "a▁b  c\x00\x01 \x1c é漢 <|endoftext|>\n x", "en", "c"), (7, "One Two", "en", "c")]
    return [(k, t, lang, s, len(t or ""), "clash") for k, t, lang, s in out]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).cache()


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def roots(n, links):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1


def test_viterbi_is_the_best_segmentation():
    m = pieces.model(registry.PIECE_MODEL)
    vocabulary = {s: m.score[i] for i, s in enumerate(m.pieces) if i in m.score}

    def best(s):
        score = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 24), j):
                c = vocabulary.get(s[i:j], m.unknown if j == i + 1 else -math.inf)
                score[j] = max(score[j], score[i] + c)
        return score[-1]

    for t in ["Thntblere", "▁hello▁world", "▁▁▁x", "é漢字", "internationalisation"]:
        ids = m.viterbi(t)
        cost, i = 0.0, 0
        while i < len(ids):
            if ids[i] in m.score:
                cost, i = cost + m.score[ids[i]], i + 1
            else:  # one character's byte pieces
                n = 1
                while m.raw[ids[i]][0] >= 0xC0 and i + n < len(ids) and m.raw[ids[i + n]] and len(m.raw[ids[i + n]]) == 1 and 0x80 <= m.raw[ids[i + n]][0] < 0xC0:
                    n += 1
                cost, i = cost + m.unknown, i + n
        assert abs(cost - best(t)) < 1e-9


def test_words_apart_equal_the_whole_and_decode_back():
    m = pieces.model(registry.PIECE_MODEL)
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["a", "The", " ", "  ", "\n", " \n", "é", "漢", "\x01", "▁", ".", "ing"]) for _ in range(rng.randint(0, 12)))
        ids = m.encode(t)
        if t and "▁" not in t:
            assert ids.tolist() == m.viterbi("▁" + t.replace(" ", "▁"))
        assert m.decode(ids.tolist()) == t


def test_trie_finds_every_prefix():
    keys = {k.encode(): i for i, k in enumerate(["a", "ab", "abc", "b", "é", "éa"])}
    t = pieces.Trie(keys)
    assert sorted(t.prefixes(b"abcd", 0)) == [(1, 0), (2, 1), (3, 2)] and list(t.prefixes(b"x", 0)) == []


def test_round_trip(spark, odd, docs, none):
    for d in (odd, docs.limit(40)):
        rows = pieces.round_trip(spark, d, registry.PIECE_MODEL).collect()
        assert len(rows) == d.count() and all(r["exact"] for r in rows)
    assert pieces.round_trip(spark, none, registry.PIECE_MODEL).count() == 0
    enc = pieces.encode_documents(odd, registry.PIECE_MODEL)
    assert all((r["text"] or "") == r["decoded"] for r in pieces.decode_documents(enc, registry.PIECE_MODEL).collect())


# 2


def brute_top(rows, k):
    v = {i: [math.floor(256 * float(np.float64(x))) for x in e] for i, e in rows}
    out = {}
    for q in v:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], e)), i) for i, e in v.items() if i != q and len(e) == len(v[q]))
            out[q] = [(i, -n) for n, i in s[:k]]
    return out


def test_top_k(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    got = defaultdict(list)
    for r in topk.top_k(e, F.col("vec_id") % 50 == 0, shard_rows=64, query_rows=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == brute_top([(r["vec_id"], r["embedding"]) for r in e.collect()], 5)


def test_top_k_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x"), (3, None, "x"), (4, [float("nan"), 1.0], "x"), (5, [None, 1.0], "x"), (6, [1.0], "x"), (50, [1e12, -1e6], "x"), (None, [1.0, 1.0], "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in topk.top_k(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == brute_top([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (6, [1.0]), (50, [1e12, -1e6])], 5)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# 3


def brute_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_near_duplicates(spark, odd, docs, none):
    for d in (odd, docs):
        rows = d.select("doc_id", "text").collect()
        fp = [brute_simhash(r["text"]) for r in rows]
        top = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
        least = {}
        for r, t in zip(rows, top):
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
        want = Counter((r["doc_id"], f"{f:016x}", least[t]) for r, f, t in zip(rows, fp, top))
        assert Counter(tuple(r) for r in simhash.near_duplicates(d).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_crowded_fingerprints(spark):
    rng = random.Random(5)
    hub = rng.getrandbits(64)
    fps = {hub} | {hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    fps = sorted(fps)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    d = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    from meridian.llm.common import components

    got = {r["node"]: r["component"] for r in components(simhash.links(d)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


# 4


def test_sharding(spark, docs, odd, none):
    big = docs.unionByName(docs.select((F.col("doc_id") + 100000).alias("doc_id"), *docs.columns[1:])).unionByName(docs.limit(1).crossJoin(spark.range(300)).select((F.col("id") + 500000).alias("doc_id"), *docs.columns[1:]))
    for d in (big, odd):
        rows = sharding.shard_documents(d, 16 if d is big else 3).collect()
        src = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in d.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == src
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rows = sharding.shard_documents(big).collect()
    size = Counter()
    groups = defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        groups[r["text_crc32"]].append(r["shard"])
    assert max(size.values()) - min(size.values()) < 1.1 * max(r["size"] for r in rows) and len(size) == 16
    together = [len(set(s)) == 1 for s in groups.values() if len(s) == 2]
    assert sum(together) > 0.5 * len(together)
    assert sharding.shard_documents(none).count() == 0


def test_sharding_keeps_linked_documents_together(spark):
    # All documents have copies: pairs, groups of 20, and one group of three shards' bytes.
    rng = random.Random(6)
    texts = [f"{i} " + "x" * rng.randint(50, 400) for i in range(700) for _ in range(20 if i % 10 == 0 else 2)]
    quota = sum(len(t) + 1 for t in texts) / 13
    rows = [(i, t) for i, t in enumerate([*texts, *["hot" * 40] * int(3 * quota / 121)])]
    shards, size, count = defaultdict(Counter), Counter(), Counter(t for _, t in rows)
    for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        shards[r["text_crc32"]][r["shard"]] += 1
        size[r["shard"]] += r["size"]
    hot = shards.pop(zlib.crc32(b"hot" * 40))
    assert all(len(s) == 1 for s in shards.values()) and sum(n for _, n in hot.most_common(4)) > 0.97 * sum(hot.values())
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 16 and len(size) == 16 and sum(hot.values()) == count["hot" * 40]


def test_doubled_corpus_keeps_its_pairs(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    d = d.unionByName(d.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    rows = sharding.shard_documents(d).collect()
    size, shards = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        shards[r["text_crc32"]].append(r["shard"])
    pairs = [len(set(s)) == 1 for s in shards.values() if len(s) == 2]
    assert sum(pairs) >= 0.9 * len(pairs) and max(size.values()) - min(size.values()) < 1.1 * max(r["size"] for r in rows)


def test_netted_flows():
    # Every shard is full: opposite flows pass, a cycle passes, one-way flows do not.
    full = np.full(3, 10.0)
    asked = np.array([[0, 5, 0], [3, 0, 4], [2, 0, 0]])
    g = sharding.netted(asked, full, 10)
    assert (g <= asked).all() and (full + g.sum(0) - g.sum(1) <= 10.5).all() and g.sum() > 8
    assert sharding.netted(np.array([[0, 5], [0, 0]]), full[:2], 10).sum() < 1


# 5


def test_lm_words_of_many_texts():
    texts = [None, "", " \t", "É A\x0bb\x1cC", *["Zé à\xa0x " * 500] * 20, "é" * 3000]
    n, words = lm._words(texts)
    want = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [w for x in want for w in x]


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_lm_is_a_distribution_and_matches_a_plain_walk(spark, docs, odd, none):
    """A plain backoff model over dictionaries: three words, two, one; with the registered query's parameters and others."""
    start = b" "
    for d, least, arc, more in ((docs, 2, 2, {}), (odd, 2, 2, {}), (odd, 1, 1, {"least": 1, "arc_least": 1}), (docs, 20, 3, {"least": 20, "arc_least": 3, "part_bytes": 100_000})):
        rows = d.select("doc_id", "text").collect()
        c, c2, c3, starts = Counter(), Counter(), Counter(), 0
        for r in rows:
            if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
                t = [start, *lm_tokens(r["text"])]
                c.update(t[1:])
                c2.update(zip(t, t[1:]))
                c3.update(zip(t, t[1:], t[2:]))
                starts += 1
        n, v = sum(c.values()), len(c)
        seen = {**c, start: starts}
        state = {w for w, k in c.items() if k >= least} | {start}
        arcs2 = {k: x for k, x in c2.items() if k[0] in state and k[1] in state and x >= arc}
        arcs3 = {k: x for k, x in c3.items() if x >= arc and k[:2] in arcs2 and k[1:] in arcs2}
        mass = Counter()
        for k, x in [*arcs2.items(), *arcs3.items()]:
            mass[k[:-1]] += x - 0.75
        root = lambda w: (c[w] + 1) / (n + v + 1)

        def p(h, w):
            if not h:
                return root(w)
            many, arcs = (seen.get(h[0], 0), arcs2) if len(h) == 1 else (arcs2.get(h, 0), arcs3)
            if h[-1] not in state or not many:
                return p(h[1:], w)
            return (1 - mass[h] / many) * p(h[1:], w) + ((arcs[*h, w] - 0.75) / many if (*h, w) in arcs else 0)

        for h in [(start,), *[(w,) for w in list(c)[:5]], *list(arcs2)[:5], *[k[:2] for k in list(arcs3)[:5]]]:
            if h[-1] != b"":
                assert abs(sum(p(h, w) for w in c) + p(h, b"\0none") - 1) < 1e-9
        want = Counter()
        for r in rows:
            t = [start, *lm_tokens(r["text"])]
            score = sum(math.log10(p(tuple(t[max(0, i - 2) : i]), t[i])) for i in range(1, len(t)))
            want[r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, len(t) - 1, sum(c[w] > 0 for w in t[1:]), n, round(sum(math.log10(root(w)) for w in t[1:]), 5), round(score, 5)] += 1
        got = Counter((*tuple(r)[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in lm.score_documents(spark, d, **more).collect())
        assert got == want
    assert lm.score_documents(spark, none).count() == 0


def test_lm_learns_pairs_of_rare_words_at_any_size(spark):
    # A pair of words seen a few times among 600,000 tokens: its second word is scored by the arc.
    rows = [(i, "aa bb " * 500) for i in range(700)] + [(1000 + i, "rare pair") for i in range(6)]
    train = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    n = sum(len(lm_tokens(t)) for _, t in train)
    seen = sum(t == "rare pair" for _, t in train)
    assert n > 500_000 and 2 < seen < n * 1e-5
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=500_000).collect()}
    starts, root = len(train), lambda c: (c + 1) / (n + 5 + 1)  # of aa, bb, rare, pair and the end

    def p(c_h, c_hw, c_w, arcs, mass):
        return (c_hw - 0.75) / c_h + (1 - (mass - 0.75 * arcs) / c_h) * root(c_w)

    want = p(starts, seen, seen, 2, starts)
    # After two words all that was ever read follows them: three arcs, each with what failure leaves.
    for c_w in (seen, starts):
        want *= (seen - 0.75) / seen + 0.75 / seen * p(seen, seen, c_w, 1, seen)
    assert all(abs(got[1000 + i] - math.log10(want)) < 1e-9 for i in range(6))


# 6


def test_targets_stop_at_three_times():
    size, w = np.array([100, 10, 5]), np.array([1.0, 2.0, 3.0])
    t = mixing.targets(size, w)
    assert np.allclose(t, [70, 30, 15]) and abs(t.sum() - size.sum()) < 1e-9


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(2)
    for _ in range(50):
        v, seats = rng.integers(1, 1000, 7).astype(float), int(rng.integers(1, 60))
        caps = rng.integers(1, 15, 7)
        want = np.zeros(7, int)
        for _ in range(min(seats, caps.sum())):
            q = np.where(want < caps, v / (2 * want + 1), -1)
            want[int(np.argmax(q))] += 1
        assert mixing.sainte_lague(v, seats, caps).tolist() == want.tolist()


def test_mixing(spark, docs, odd, none):
    for d in (docs, odd.drop("size")):
        rows = mixing.mix_sources(spark, d).collect()
        words = Counter((r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in d.collect())
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == words
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        taken, target = Counter(), {}
        for r in rows:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        if d is docs:
            assert all(abs(taken[s] - t) <= max(64, 0.01 * t) for s, t in target.items())
            again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(spark, d.repartition(7)).collect()}
            assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix_sources(spark, none.drop("size")).count() == 0


# 7


def test_encoder_equals_the_library():
    e = idstore.encoder(registry.BYTE_BPE)
    rng = random.Random(4)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "!!", "'s", "12", "é", "漢", "\xa0", " \n", "\n ", "<|endoftext|>", "\x1c", "it's", "²", "_", "​", "\x00", ".", ","]
    texts = ["".join(rng.choice(parts[:12] if i % 2 else parts) for _ in range(rng.randint(0, 14))) for i in range(3000)]
    for t, ids in zip(texts, e.encode_many(texts)):
        assert ids.tolist() == e.library.encode(t, add_special_tokens=False).ids
    small, kept = idstore.Encoder(registry.BYTE_BPE), idstore.KEPT
    try:  # words that leave the cache and come back
        idstore.KEPT = 5
        assert [x.tolist() for x in small.encode_many(texts[:300])] == [x.tolist() for x in e.encode_many(texts[:300])]
    finally:
        idstore.KEPT = kept


def test_chunks_depend_on_content():
    ids = np.random.default_rng(1).integers(0, 50000, 60000).astype("<u4")
    ends = idstore.cuts(ids)
    assert ends[-1] == len(ids) and all(idstore.LEAST <= b - a <= idstore.MOST for a, b in zip([0, *ends[:-2]], ends[:-1]))
    digest = lambda x: {x[a:b].tobytes() for a, b in zip([0, *idstore.cuts(x)[:-1]], idstore.cuts(x))}
    assert len(digest(ids) & digest(np.r_[np.arange(77, dtype="<u4"), ids])) > 0.8 * len(ends)


def test_id_store(spark, docs, odd, none):
    lib = idstore.encoder(registry.BYTE_BPE).library
    big = 2**53 + 1  # not a double
    null_ids = spark.createDataFrame([(None, "One Two"), (big, "Three"), (None, None), (big - 2, "Four")], "doc_id long, text string")
    for d in (docs.limit(60).unionByName(docs.limit(60).withColumn("doc_id", F.col("doc_id") + 900)), odd, null_ids):
        rows, want, start = sorted(d.select("doc_id", "text").collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "\uffff")), [], 0
        for r in rows:
            ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted((tuple(r) for r in idstore.round_trip(spark, d, registry.BYTE_BPE, 2).collect()), key=lambda r: r[1])
        # Rows of one id (or of none) are in any order among themselves.
        unordered = lambda rows: Counter((k, n, c) for k, _, n, c in rows)
        assert unordered(got) == unordered(want) and [r[0] for r in got] == [r[0] for r in want]
        assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
        assert d is null_ids or got == want
    s = idstore.write_ids(spark, docs.limit(20).crossJoin(spark.range(3)).select((F.col("doc_id") * 3 + F.col("id")).alias("doc_id"), "text"), registry.BYTE_BPE, 2)
    assert s.index.count() == s.index.select("digest").distinct().count()
    assert [r["place"] for r in s.recipes.orderBy("doc_id").collect()] == list(range(60))
    with pytest.raises(ValueError):
        idstore.read_ids(s._replace(root="0" * 64))
    assert idstore.round_trip(spark, none, registry.BYTE_BPE, 2).count() == 0


# 8


def test_warc(spark, small):
    pages = [(1, "http://a", "x" * 200_000 + "é"), (2, "http://b", None), (3, "http://c", ""), (4, "http://d", "same"), (9, None, "same"), (7, " ", "same"), (9, "http://e", "same")]
    d = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha1 string")
    for d, rows in ((d, pages), (spark.read.parquet(f"{small}/pages.parquet"), None)):
        rows = rows or [tuple(r) for r in d.select("page_id", "url", "html").collect()]
        top = {}
        for k, _, h in rows:
            top[h or ""] = max(top.get(h or "", k), k)
        want = Counter()
        for k, _, h in rows:
            raw = (h or "").encode()
            again = top[h or ""] != k
            want[k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None] += 1
        m = warc.write_warc(spark, d)
        assert Counter(tuple(r) for r in warc.records(m).collect()) == want
        chunks = defaultdict(dict)
        for r in warc.read_warc(m).where("record_type = 'response'").collect():
            chunks[r["page_id"]][r["chunk_no"]] = bytes(r["data"])
            assert len(r["data"]) <= warc.PIECE
        texts = {k: (h or "").encode() for k, _, h in rows}
        assert all(b"".join(c[i] for i in sorted(c)) == texts[k] for k, c in chunks.items())
    assert warc.records(warc.write_warc(spark, d.limit(0))).count() == 0


def test_warc_by_another_reader(spark):
    big = 2**53 + 1
    rows = [(big, "http://a", "x\r\n\r\ny" * 9), (big - 2, "http://b", "x\r\n\r\ny" * 9), (None, "http://c", "é"), (None, None, None), (3, "u", "WARC/1.1")]
    m = warc.write_warc(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = []
    for path in [r["path"] for r in m.collect()]:
        raw = gzip.decompress(open(path.removeprefix("file://"), "rb").read())
        while raw:  # a record: header lines, a blank line, the block, two line ends
            head, _, rest = raw.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            h = dict(x.split(": ", 1) for x in lines)
            assert first == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(h)
            n = int(h["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            found.append((h["WARC-Record-ID"], h["WARC-Type"], rest[:n].partition(b"\r\n\r\n")[2].decode(), h.get("WARC-Refers-To")))
            raw = rest[n + 4 :]
    text = "x\r\n\r\ny" * 9
    # Of the two without an id and of different payloads neither revisits.
    assert Counter(found) == Counter([(f"<urn:page:{big}>", "response", text, None), (f"<urn:page:{big - 2}>", "revisit", "", f"<urn:page:{big}>"), ("<urn:page:null>", "response", "é", None), ("<urn:page:null>", "response", "", None), ("<urn:page:3>", "response", "WARC/1.1", None)])
    assert {r["page_id"] for r in warc.records(m).collect()} == {big, big - 2, None, 3}


def test_ids_stay_exact_beside_nulls(spark):
    big = 2**53 + 1
    rows = [(big, "One two three four"), (None, "five"), (big - 2, None), (None, None)]
    d = spark.createDataFrame([(*r, "clash", "clash", 1.0) for r in rows], "doc_id long, text string, piece_ids string, decoded string, quality_score double").coalesce(1)
    want = Counter(r[0] for r in rows)
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    assert ids(pieces.round_trip(spark, d, registry.PIECE_MODEL)) == want
    enc = pieces.encode_documents(d, registry.PIECE_MODEL)
    back = pieces.decode_documents(enc, registry.PIECE_MODEL)
    assert ids(back) == want and Counter((r["doc_id"], r["decoded"]) for r in back.collect()) == Counter((k, t or "") for k, t in rows)
    assert ids(simhash.near_duplicates(d)) == want and ids(sharding.shard_documents(d, 2)) == want
    assert ids(mixing.mix_sources(spark, d.select("doc_id", "text").withColumn("source", F.lit("a")))) == want
    scored = lm.score_documents(spark, d).collect()
    assert Counter(r["doc_id"] for r in scored) == want and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in scored if r["doc_id"])
    m = quality.fit(d, spark.createDataFrame([(big, 1)], "doc_id long, quality int"))
    assert ids(quality.score_documents(spark, d, m)) == want


# 9


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality.score_documents(spark, docs, m).withColumn("held", quality.held_out()).collect()}
    held = [(r["quality"], rows[r["doc_id"]]["quality_score"]) for r in labels.collect() if rows[r["doc_id"]]["held"]]
    assert all(rows[k]["held"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in rows)
    assert np.mean([(s >= 0.5) == q for q, s in held]) > 0.93
    x = quality.dense([quality.features(r["text"]) for r in docs.limit(30).collect()])
    y = m._unit(m._weigh(x) @ m.axes)
    for i, s in enumerate(m.score(x)):
        near = sorted(range(len(m.labels)), key=lambda j: -float(y[i] @ m.vectors[j]))[: m.near]
        w = [max(float(y[i] @ m.vectors[j]), 0) ** 8 + 1e-9 for j in near]
        assert abs(s - sum(a * m.labels[j] for a, j in zip(w, near)) / sum(w)) < 1e-3


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0), (5, None), (8, 1), (99, 0)], "doc_id long, quality int")
    m = quality.fit(odd, labels)
    rows = quality.score_documents(spark, odd, m).collect()
    assert len(rows) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert quality.score_documents(spark, none, quality.fit(none, labels.limit(0))).count() == 0


# 10


def test_near_vectors(spark, small):
    e = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    for i in range(150):  # a crowd around one vector, and copies of one
        e.append((10_000 + i, [float(x) for x in base + 0.15 * rng.standard_normal(64)], 77))
        e.append((20_000 + i, [float(x) for x in base], 77))
    e += [(30_000, None, 1), (30_001, [0.0] * 64, 1), (30_002, [float("nan")] * 64, 1), (30_003, [None] * 64, 1), (30_004, [1.0] * 64, None), (30_005, [1.0, 2.0], 1), (30_006, [1.0, 2.0], 1), (30_007, [], 1)]
    d = spark.createDataFrame([(*r, "clash") for r in e], "vec_id long, embedding array<double>, label int, rep string")
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    groups = defaultdict(list)
    for k, v, lab in e:
        if lab is not None and ok(v):
            groups[lab, len(v)].append((k, np.array(v, float) / np.linalg.norm(np.array(v, float))))
    links, pairs = Counter(), []
    for g in groups.values():
        c = np.stack([v for _, v in g]) @ np.stack([v for _, v in g]).T
        for i, j in zip(*np.nonzero(np.triu(c >= 0.93, 1))):
            a, b = g[i][0], g[j][0]
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    at = {k: i for i, k in enumerate(sorted(r[0] for r in e))}
    top = roots(len(at), [(at[a], at[b]) for a, b in pairs])
    got = vectors.near_vectors(d).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(r[0] for r in e)
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got) and sum(r["n_links"] for r in got) >= 0.99 * sum(links.values())
    names = sorted(at)
    assert all(r["component_id"] == names[top[at[r["vec_id"]]]] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_vectors(d.limit(0)).count() == 0


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    big = 2**53 + 1
    rows = [(0, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (50, [1.0, 1.0]), (50, [0.0, 5.0]), (None, [9.0, 9.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0, k=2).collect())
    u = 256 * 256
    want = [(0, 1, 1, 6 * u), (0, 2, 1, 4 * u), (50, 1, 50, 5 * u), (50, 2, 1, 3 * u), (50, 1, 50, 5 * u), (50, 2, 0, 0)]
    assert got == Counter(want)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (big, [0.0, 2.0]), (None, [0.01, 1.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (big - 2, [0.0, -1.0])]
    d = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, label int").coalesce(1)
    got = Counter(tuple(r) for r in vectors.near_vectors(d).collect())
    # The two rows of id 1 are in two components, each of which is named by it.
    want = [(1, 1, 1, True), (None, 1, 1, False), (1, 2, 1, True), (big, 2, 1, False), (None, 2, 1, False), (None, 0, None, False), (big - 2, 0, big - 2, True)]
    assert got == Counter(want)


def test_vectors_near_the_threshold_are_found(spark):
    rng = np.random.default_rng(12)
    rows, pairs = [], 0
    for i in range(600):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9301, 0.95)
        rows += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), i % 3)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[2 * i] >= 1 for i in range(600)) >= 0.98 * 600
