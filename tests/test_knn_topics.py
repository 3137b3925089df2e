import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from agora.operators import knn as K
from agora.operators import topics as TP
from agora.sources import fixtures as fx
from tests.conftest import SF


def _pts(spark, n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(6, d)) * 4
    x = c[rng.integers(0, 6, n)] + rng.normal(size=(n, d))
    pdf = pd.DataFrame({"doc_id": np.arange(n), "embedding": [r.tolist() for r in x]})
    return x, spark.createDataFrame(pdf, "doc_id long, embedding array<double>")


def test_knn_exact_matches_brute_force(spark):
    x, df = _pts(spark)
    got = K.knn_exact(df, 4, block_rows=64).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dm = 1 - u @ u.T
    np.fill_diagonal(dm, np.inf)
    for s, g in got.groupby("src"):
        want = np.argsort(dm[s], kind="stable")[:4]
        assert list(g.sort_values("rank").dst) == list(want)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_knn_lsh_recall(spark, sf):
    """The registered query's parameters on the given vectors."""
    v = fx.vectors(spark, SF[sf])
    assert K.recall(E.queries()["knn_lsh"](spark, SF[sf]), K.knn_exact(v, 5)).first().recall >= 0.9


def test_descent_finds_what_buckets_lose(spark):
    x, df = _pts(spark, n=900)
    exact = K.knn_exact(df, 5)
    points = df.select(F.col("doc_id").alias("_id"), F.col("embedding").alias("_v"))
    rng = np.random.default_rng(3)
    start = [(i, int(j)) for i in range(900) for j in rng.choice(900, 12, replace=False) if i != j]
    pairs = spark.createDataFrame(start, "src long, dst long")
    graph = K.top_k_edges(K._distances(points, pairs, "cosine"), 12)
    assert K.recall(graph, exact).first().recall < 0.1
    got = K.descend(points, graph, 12)
    assert K.recall(got.filter("rank <= 5"), exact).first().recall >= 0.9
    assert got.groupBy("src").count().filter("count > 12").count() == 0


def test_bits_follow_the_rows():
    assert [K.bits_for(n) for n in (0, 1, 256, 1000, 10**6, 10**9)] == [0, 0, 0, 1, 11, 21]


def test_mmr_small_case(spark):
    cand = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c")], "topic int, term string")
    tv = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.1]), ("c", [0.6, 0.8])],
                               "term string, embedding array<double>")
    top = spark.createDataFrame([(0, [1.0, 0.0])], "topic int, embedding array<double>")
    r = TP.mmr(cand, tv, top, top_n=2, diversity=0.8).orderBy("rank").toPandas()
    # first the most similar word, then the one least redundant with it
    assert list(r.term) == ["a", "c"]


def test_assign_topics_and_ctfidf(spark):
    cl = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, -1), (5, 9), (6, 9)], "doc_id long, cluster int")
    t = {r.doc_id: r.topic for r in TP.assign_topics(cl).collect()}
    assert t == {1: 0, 2: 0, 3: 2, 4: -1, 5: 1, 6: 1}
    cc = spark.createDataFrame([(0, "x", 3), (0, "y", 1), (1, "x", 1)], "topic int, term string, n long")
    got = {(r.topic, r.term): r.score for r in TP.ctfidf(cc).collect()}
    a = 2.0  # floor(mean(4, 1)) = 2
    assert abs(got[(0, "x")] - 0.75 * np.log(1 + a / 4)) < 1e-12
    assert abs(got[(1, "x")] - 1.0 * np.log(1 + a / 4)) < 1e-12
    assert abs(got[(0, "y")] - 0.25 * np.log(1 + a / 1)) < 1e-12


def test_points_go_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """Rows that meet in tasks grow with the points, however small the blocks are."""
    def counted(k, metric):
        return lambda t: pa.table({"src": [t.num_rows], "dst": [0], "distance": [0.0]})
    monkeypatch.setattr(K, "_block_fn", counted)
    for n in (1000, 4000):
        _, df = _pts(spark, n=n)
        met = K.blocked_topk(df.select(F.col("doc_id").alias("_id"), F.col("embedding").alias("_v")), 3, block_rows=16)
        assert met.agg(F.sum("src")).first()[0] == n * K.MOST_BLOCKS


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_tiles_give_the_nearest_of_two_blocks(monkeypatch, metric):
    monkeypatch.setattr(K, "_TILE", (8, 16))
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (150, 3)).astype(float)  # many ties, copies and zero vectors
    ids = rng.permutation(400)[:150]
    of = (np.arange(150) % 3 == 0).astype(int)
    for sides in (of, of * 0):
        t = pa.table({"_side": sides, "_id": ids, "_v": x.tolist()})
        got = K._block_fn(4, metric)(t).to_pandas()
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = 1 - unit @ unit.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for i in range(150):
            others = [j for j in range(150) if j != i and (sides[j] != sides[i] or not sides.any())]
            want = sorted((round(d[i, j], 9) + 0.0, ids[j]) for j in others)[:4]
            mine = got[got.src == ids[i]]
            assert sorted(zip(mine.distance.round(9) + 0.0, mine.dst)) == want


def test_pairs_that_meet_at_a_point(spark):
    """Every pair of a piece with a new end whose distance the list's worst allows."""
    rng = np.random.default_rng(6)
    rows = [(int(m), int(p), int(e), bool(rng.random() < 0.4), float(rng.random()) if e % 3 else None, rng.normal(size=2).tolist())
            for m in range(40) for p in range(2) for e in rng.choice(50, int(rng.integers(1, 9)), replace=False)]
    dealt = spark.createDataFrame(rows, "mid long, piece long, end long, new boolean, worst double, v array<double>")
    got = {(r[0], r[1], round(r[2], 9)) for r in K._met(dealt, "euclidean").collect()}
    far = lambda a, b: float(np.linalg.norm(np.array(a[5]) - np.array(b[5])))
    want = {(a[2], b[2], round(far(a, b), 9)) for a in rows for b in rows
            if a[:2] == b[:2] and a[2] != b[2] and (a[3] or b[3]) and (a[4] is None or far(a, b) <= a[4])}
    assert got == want


def test_pairwise_distances_are_of_all_pairs(spark, monkeypatch, tmp_path):
    """The registered query against its SQL: every pair, with an id twice, a null vector and one without length."""
    import duckdb
    monkeypatch.setattr(K, "_STRIP_ROWS", 7)
    monkeypatch.setattr(K, "_SENT", 10)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(40, 6)) / 3).tolist()
    x[4], x[8] = x[3], [0.0] * 6
    rows = [(i, v) for i, v in enumerate(x)] + [(3, x[3]), (7, x[11]), (50, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in E.queries()["pairwise_cosine_distance"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet') "
                "WHERE embedding IS NOT NULL")
    want = con.execute(E.oracle_sql()["pairwise_cosine_distance"]).fetchall()
    assert len(got) == 42 * 42 - 42 - 2 * 2  # but a row with itself, or with the other row of its id
    assert sorted(got) == sorted(want)


def test_pairwise_distances_by_euclid_and_with_a_missing_component(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0]), (4, [None, 1.0])],
                               "doc_id long, embedding array<double>")
    got = {(r.src, r.rank): (r.dst, r.distance) for r in K.pairwise_distances(df, metric="euclidean").collect()}
    assert len(got) == 12 and got[1, 1] == (3, 1.0) and got[1, 2] == (2, 5.0) and got[1, 3] == (4, None)
    assert {r.distance for r in K.pairwise_distances(df).filter("src = 4 or dst = 4").collect()} == {None}


def test_candidates_come_as_lists(spark, monkeypatch):
    """A row per point and block, and after the merge the same edges as from single candidates, ids twice included."""
    monkeypatch.setattr(K, "_MERGED", 300)
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (400, 3)).astype(float)
    ids = [*range(396), 7, 7, 11, 20]
    x[396:] = x[[7, 7, 11, 20]]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "_id long, _v array<double>")
    for metric in ("cosine", "euclidean"):
        lists = K.blocked_topk(df, 5, None, metric, 50, lists=True)
        assert lists.count() <= 400 * 8  # 400 rows in 8 blocks of 50
        got = {(r.src, r.rank): (r.dst, round(r.distance, 9)) for r in K.nearest(df, 5, None, metric, 50).collect()}
        want = {(r.src, r.rank): (r.dst, round(r.distance, 9))
                for r in K.top_k_edges(K.blocked_topk(df, 5, None, metric, 50), 5).collect()}
        assert got == want and len(got) > 396 * 4
    assert K.nearest(df.filter("_id < 0"), 5).count() == 0 and K.nearest(df.filter("_id = 3"), 5).count() == 0


def test_nearest_of_copies_and_small_distances():
    """Points that are alike to within rounding, in tiles that are smaller than what passes."""
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(7, 4)), 300, axis=0) + np.arange(2100)[:, None] % 3 * 1e-5
    ids = np.arange(2100)
    for metric in ("euclidean", "cosine"):
        y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
        got = pa.concat_tables(K._nearest_of(ids, y, ids, y, 6, metric)).to_pandas()
        assert (got.groupby("src").size() == 6).all() and (got.src != got.dst).all()
        assert (got.src // 300 == got.dst // 300).all() and got.distance.max() < 1e-6
