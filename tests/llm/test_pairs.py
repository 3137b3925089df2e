"""Jaccard join, top-k search and fingerprints against brute force."""
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import jaccard_join, syncmers, topk_search
from agora.llm.common import table
from tests.llm.helpers import awkward, empty, lower, words

SF = "/root/testdata/sf0.001"


def _set(text):
    w = words(lower(text))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(rows):
    sets = [(i, _set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {(i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets)}


def _same(df):
    want = _components([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = jaccard_join.join(df).collect()
    assert len(got) == df.count()
    assert {tuple(r) for r in got} == want


def test_join_on_documents(spark):
    _same(table(spark, SF, "documents"))


def test_join_edges(spark):
    _same(awkward(spark).filter("doc_id is not null"))
    assert jaccard_join.join(empty(spark)).count() == 0
    with_null = jaccard_join.join(awkward(spark)).filter("doc_id is null").collect()
    assert len(with_null) == 1 and with_null[0]["n_shingles"] > 0


def test_join_chains_thresholds_and_blocks(spark, monkeypatch):
    """Chains of neighbours at the threshold, a group of near copies larger than
    a block, and many texts around one common passage."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [vocab[i] for i in rng.integers(0, 3000, 60)]
    rows, i = [], 0
    base = [vocab[j] for j in rng.integers(0, 3000, 100)]
    for step in range(40):  # each differs from the one before by a sliding edge
        rows.append((i := i + 1, " ".join(base[step // 2:] + [f"x{k}" for k in range(step)])))
    for c in range(40):
        copy = list(base)
        copy[int(rng.integers(0, 100))] = f"y{c}"
        rows.append((i := i + 1, " ".join(copy)))
    for c in range(40):
        own = [vocab[j] for j in rng.integers(0, 3000, 30 + c)]
        rows.append((i := i + 1, " ".join(own + passage)))
    for n in range(1, 14):
        rows.append((i := i + 1, " ".join(base[:n])))
    _same(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n in (3, 40, 700, 5000):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        for share in (0.7, 0.8, 0.9, 1.0):
            a = np.unique(pool[:n])
            b = np.unique(np.concatenate([a[: int(share * n)], pool[n: n + n - int(share * n)]]))
            inner = len(np.intersect1d(a, b))
            words_ = min(len(jaccard_join._bitmap(s)) for s in (a, b))
            x, y = (jaccard_join._folded(jaccard_join._bitmap(s).view(np.uint64), words_) for s in (a, b))
            if 100 * inner >= 80 * (len(a) + len(b) - inner):
                assert jaccard_join._bound(x, y, np.int64(len(a)), np.int64(len(b)))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in jaccard_join.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{j: 100 for j in range(101, 160)}}


# --------------------------------------------------------------- top-k search

def _search(rows, queries, k):
    out = set()
    for q, qv in queries:
        score = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])}
    return out


@pytest.mark.parametrize("high", [3, 200, 2**30])
def test_search_with_ties_and_blocks(spark, monkeypatch, high):
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(high)
    rows = [(int(i), [int(x) for x in rng.integers(-high, high, 6)]) for i in range(300)]
    rows += [(500 + i, rows[0][1]) for i in range(20)]  # equal vectors tie
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit(1.0))
    queries = df.filter("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")
    got = topk_search.search(queries, df, 5)
    assert {tuple(r) for r in got.collect()} == _search(rows, [r for r in rows if r[0] % 25 == 0], 5)


def test_search_few_rows_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(0, [0.5, -0.1]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]),
           (6, [1.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<float>").filter(topk_search.usable(F.col("embedding")))
    df = df.select("vec_id", topk_search.quantized(F.col("embedding")).alias("vector"))
    assert {r["vec_id"] for r in df.collect()} == {0, 1, 6, None, 7}
    got = {tuple(r) for r in topk_search.search(df.withColumnRenamed("vec_id", "query_id"), df, 5).collect()}
    assert got == {(0, 1, 1, 128 * 256 - 26 * 256), (1, 1, 0, 128 * 256 - 26 * 256)}
    none = df.filter("vec_id < 0")
    assert topk_search.search(none.withColumnRenamed("vec_id", "query_id"), df, 5).count() == 0
    assert topk_search.search(df.withColumnRenamed("vec_id", "query_id"), none, 5).count() == 0


# --------------------------------------------------------------- fingerprints

def _anchors(text):
    """Closed syncmers by the definition, on the module's hashes of s-mers."""
    h = lambda s: int(syncmers.mix64(np.array([sum_(s)], np.uint64))[0])

    def sum_(s):
        v = 0
        for c in s:
            v = (v * syncmers._ODD + ord(c)) % 2**64
        return v
    first = {}
    for i in range(len(text) - syncmers.K + 1):
        inner = [h(text[i + j: i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            both = np.array([(inner[0] * 3 + inner[-1] * syncmers._ODD) % 2**64], np.uint64)
            first.setdefault(int(syncmers.mix64(both)[0]) >> 32, i)
    return sorted(first.items())[: syncmers.ANCHORS]


def test_anchors_by_definition():
    texts = ["", "short", "exactly12chr", "the quick brown fox jumps over the lazy dog " * 3, "日本語のテキスト" * 4, "a" * 50]
    for t, (hashes, places) in zip(texts, syncmers.anchors(texts)):
        if len(t) >= syncmers.K:
            assert list(zip(hashes.tolist(), places.tolist())) == _anchors(t)
        else:
            assert len(hashes) == (1 if t else 0)
        one = (hashes, places)
        assert syncmers.likeness(one, one) == 1.0
        assert all(np.array_equal(a, b) for a, b in zip(syncmers.read(syncmers.written(*one)), one))


def test_likeness_follows_order():
    a = (np.arange(10, dtype=np.uint64), np.arange(10) * 5)
    b = (np.arange(10, dtype=np.uint64), np.arange(10)[::-1] * 5)
    assert syncmers.likeness(a, b) == pytest.approx(0.1)
    assert syncmers.likeness(a, (np.arange(10, 20, dtype=np.uint64), np.arange(10))) == 0


def _long_pair(n, seed=3):
    """Two long texts that share nothing but a passage of 350 characters."""
    rng = np.random.default_rng(seed)
    chars = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))
    shared = chars(350)
    return [chars(n) + shared + chars(n), chars(n // 2) + shared + chars(n)]


@pytest.mark.parametrize("n", [3_000, 20_000])
def test_long_texts_keep_their_shared_passage(spark, n):
    texts = _long_pair(n)
    f, g = syncmers.anchors(texts)
    for t, (hashes, places) in zip(texts, (f, g)):
        assert len(hashes) > 0.25 * len(t)
        read = syncmers.read(syncmers.written(hashes, places))
        assert len(read[0]) > 0.025 * len(t)
        assert np.array_equal(read[0], hashes[: len(read[0])]) and np.array_equal(read[1], places[: len(read[0])])
    common = len(np.intersect1d(f[0], g[0]))
    assert common > 60
    assert len(np.intersect1d(*(syncmers.read(syncmers.written(*x))[0] for x in (f, g)))) >= 3
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # a few hashes may also meet by chance, out of order
    assert common - 5 <= round(rows[0]["near_next"] * len(np.union1d(f[0], g[0]))) <= common
    assert rows[0]["near_next"] == rows[1]["near_next"] > 0
    e = list(syncmers.anchors([syncmers.edited(*texts)]))[0]
    assert rows[0]["near_edited"] == syncmers.likeness(f, e) > 0.5


def test_written_fingerprints_are_whole_and_short():
    """Every anchor and place in at most six characters, far steps and odd numbers included."""
    rng = np.random.default_rng(8)
    chars = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))
    plain, again = chars(5_000), chars(400) * 9 + chars(301)
    for t in (plain, plain[:33], again, chars(40), "abc", ""):
        one = list(syncmers.anchors([t]))[0]
        text = syncmers.written(*one)
        assert all(np.array_equal(a, b) for a, b in zip(syncmers.read(text), one))
        assert text.isascii() and text.isprintable() and len(text) <= 6 * len(one[0]) + 10
    far = np.array([5, 2**32 - 1, 0], np.uint64), np.array([2**31, 9, 0])
    got = syncmers.read(syncmers.written(*far))
    assert got[0].tolist() == [0, 5, 2**32 - 1] and got[1].tolist() == [0, 2**31, 9]


def test_longest_rise_by_definition():
    rng = np.random.default_rng(4)
    for n in range(40):
        p = rng.permutation(n)
        swaps = np.arange(n)
        for i in rng.integers(0, max(1, n - 1), 3 if n > 1 else 0):
            swaps[[i, i + 1]] = swaps[[i + 1, i]]
        for seq in (p, swaps):
            best = [1] * n
            for i in range(n):
                best[i] = 1 + max((best[j] for j in range(i) if seq[j] < seq[i]), default=0)
            assert syncmers._longest_rise(seq) == max(best, default=0)


def _check_neighbours(df):
    got = syncmers.fingerprints(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                           "near_edited", "near_next"]
    rows = sorted(got.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    texts = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()),
                   key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    for k, (r, (_, t)) in enumerate(zip(rows, texts)):
        following = texts[(k + 1) % len(texts)][1]
        e = syncmers.edited(t, following)
        f, g, n = syncmers.anchors([t, e, following])
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (syncmers.written(*f), syncmers.written(*g))
        assert (r["near_edited"], r["near_next"]) == (syncmers.likeness(f, g), syncmers.likeness(f, n))


def test_fingerprints_of_neighbours(spark):
    _check_neighbours(table(spark, SF, "documents").repartition(7))


def test_fingerprint_edges(spark):
    _check_neighbours(awkward(spark))
    _check_neighbours(awkward(spark, only=[1]))
    assert syncmers.fingerprints(empty(spark)).count() == 0


def test_written_fingerprints_hold_every_anchor(spark):
    """Likeness can be read from the two written fingerprints: nothing is left out."""
    texts = _long_pair(2_000, seed=7)
    for one in syncmers.anchors(texts):
        assert all(np.array_equal(a, b) for a, b in zip(syncmers.read(syncmers.written(*one)), one))
    rows = syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    of = [syncmers.read(r["fingerprint"]) for r in rows]
    assert rows[0]["near_next"] == syncmers.likeness(of[0], of[1]) > 0
    for r, f in zip(rows, of):
        assert r["near_edited"] == syncmers.likeness(f, syncmers.read(r["edited_fingerprint"]))
