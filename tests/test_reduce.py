import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from agora.operators import knn as K
from agora.operators import reduce as R
from agora.operators import vectors as VO


def _blobs(spark, n=90, d=6, seed=4):
    rng = np.random.default_rng(seed)
    c = np.eye(3, d) * 10
    lab = np.repeat(np.arange(3), n // 3)
    x = c[lab] + rng.normal(size=(n, d))
    pdf = pd.DataFrame({"doc_id": np.arange(n), "embedding": [r.tolist() for r in x]})
    return x, lab, spark.createDataFrame(pdf, "doc_id long, embedding array<double>")


def test_pca_matches_numpy_up_to_sign(spark):
    x, _, df = _blobs(spark)
    got = VO.pca(df, 2).orderBy("doc_id").toPandas()
    p = np.array(got.projected.tolist())
    xc = x - x.mean(0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    ref = x @ vt[:2].T
    for k in range(2):
        a, b = p[:, k], ref[:, k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_smooth_knn_residual_and_fuzzy_union(spark):
    _, _, df = _blobs(spark)
    kn = K.knn_exact(df, 5, metric="euclidean", block_rows=32)
    sm = R.smooth_knn(kn, 5).toPandas().set_index("id")
    dist = kn.toPandas()
    for i, g in dist.groupby("src"):
        rho, sig = sm.loc[i, "rho"], sm.loc[i, "sigma"]
        s = np.exp(-np.maximum(g.distance.to_numpy() - rho, 0) / sig).sum()
        assert abs(s - np.log2(5)) < 1e-4
    fg = R.fuzzy_graph(kn, R.smooth_knn(kn, 5)).toPandas()
    assert (fg.src < fg.dst).all() and fg.weight.between(0, 1).all()


def _ring_of_cliques(cliques=6, size=8, seed=3):
    rng = np.random.default_rng(seed)
    edges = {}
    for c in range(cliques):
        for a in range(size):
            for b in range(a + 1, size):
                edges[c * size + a, c * size + b] = 0.2 + 0.8 * rng.random()
    for c in range(cliques - 1):
        edges[c * size, (c + 1) * size] = 0.1 + 0.05 * c
    return cliques * size, edges


def test_spectral_start_matches_numpy_up_to_sign(spark):
    n, edges = _ring_of_cliques()
    w = np.zeros((n, n))
    for (a, b), x in edges.items():
        w[a, b] = w[b, a] = x
    s = 1 / np.sqrt(w.sum(0))
    _, vec = np.linalg.eigh(np.eye(n) - s[:, None] * w * s)
    df = spark.createDataFrame([(a, b, float(x)) for (a, b), x in edges.items()], "src long, dst long, weight double")
    got = np.array([r.coords for r in R.spectral_start(df, 3, more=4).orderBy("id").collect()])
    assert got.shape == (n, 3)
    for j in range(3):
        want = vec[:, j + 1]
        assert min(np.abs(got[:, j] - want).max(), np.abs(got[:, j] + want).max()) < 1e-4


def test_spectral_start_of_small_and_split_graphs(spark):
    schema = "src long, dst long, weight double"
    assert R.spectral_start(spark.createDataFrame([], schema), 2).collect() == []
    two = {r.id: r.coords for r in R.spectral_start(spark.createDataFrame([(1, 2, 0.5)], schema), 2).collect()}
    assert set(two) == {1, 2} and all(len(c) == 2 and c[1] == 0.0 for c in two.values())
    assert abs(two[1][0] + two[2][0]) < 1e-9  # eigenvector (1, -1) / sqrt(2)
    # two triangles: the vectors of eigenvalue 0 are constant within each
    tri = [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (5, 6, 1.0), (5, 7, 1.0), (6, 7, 1.0)]
    got = {r.id: r.coords[0] for r in R.spectral_start(spark.createDataFrame(tri, schema), 1).collect()}
    assert np.ptp([got[i] for i in (0, 1, 2)]) < 1e-6 and np.ptp([got[i] for i in (5, 6, 7)]) < 1e-6


def test_layout_is_trustworthy(spark):
    """From a start without order, neighbours end up as neighbours."""
    x, lab, df = _blobs(spark)
    n, k = len(x), 5
    kn = K.knn_exact(df, 8, metric="euclidean")
    graph = R.fuzzy_graph(kn, R.smooth_knn(kn, 8))
    rng = np.random.default_rng(0)
    init = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(n)], "id long, coords array<double>")
    ranks = K.knn_exact(df, n - 1, metric="euclidean").select("src", "dst", "rank")

    def trust(coords):
        near = K.knn_exact(coords.withColumnsRenamed({"id": "doc_id", "coords": "embedding"}), k, metric="euclidean")
        return R.trustworthiness(near, ranks, n, k).first()[0]
    before, after = trust(init), trust(R.layout(graph, init, n_epochs=25))
    assert before < 0.6 and after > 0.75


def test_given_coordinates(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<double>")
    given = spark.createDataFrame([(1, [5.0, 6.0]), (3, [7.0, 8.0])], "id long, coords array<double>")
    assert [tuple(r) for r in R.reduce(df, "given", coords=given).collect()] == [(1, [5.0, 6.0])]


def test_principal_axes_span_numpys_space(spark):
    rng = np.random.default_rng(11)
    d, k = 120, 5
    scale = np.concatenate([np.linspace(9, 5, k), np.full(d - k, 0.5)])
    x = rng.normal(size=(400, d)) * scale @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 3.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    axes = VO.principal_axes(df, k)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(axes @ axes.T, np.eye(k), atol=1e-9)
    assert np.abs(np.abs(axes @ vt[:k].T) - np.eye(k)).max() < 1e-2
    out = {r["doc_id"]: r["p"] for r in VO.project(df, axes, "embedding", "p").collect()}
    assert out[400] is None and np.allclose(np.array([out[i] for i in range(400)]), x @ axes.T)


def test_wide_vectors_take_the_range_finder(spark, monkeypatch):
    x, _, df = _blobs(spark)
    exact = np.array(VO.pca(df, 2).orderBy("doc_id").toPandas()["projected"].tolist())
    monkeypatch.setattr(VO, "EXACT_DIMS", 4)
    wide = np.array(VO.pca(df, 2).orderBy("doc_id").toPandas()["projected"].tolist())
    assert np.allclose(np.abs(exact), np.abs(wide), atol=1e-3)


def test_axes_of_few_or_equal_vectors(spark):
    import pytest
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], "doc_id long, embedding array<double>")
    assert VO.principal_axes(same, 2).shape == (2, 3)
    assert VO.principal_axes(same.limit(1), 9).shape == (3, 3)
    with pytest.raises(ValueError):
        VO.principal_axes(same.filter("doc_id > 9"), 2)


def test_sums_of_arrays_are_compiled(spark):
    rows = spark.createDataFrame([(1, 2.0, [1.0, 5.0]), (1, 1.0, [3.0, -1.0]), (2, 1.0, [0.5, 0.0])], "id long, m double, v array<double>")
    got = R._summed(rows, [F.get("v", F.lit(j)) * F.col("m") for j in range(2)], "my")
    assert {r.id: r.my for r in got.collect()} == {1: [5.0, 9.0], 2: [0.5, 0.0]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan


def test_forces_are_summed_without_objects(spark, monkeypatch):
    """No epoch of the layout or product of the spectral start makes an object of an edge."""
    plans = []
    share = R.write_shared
    monkeypatch.setattr(R, "write_shared", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), share(df, name))[1])
    edges = spark.createDataFrame([(i, (i + 1) % 9, 1.0) for i in range(9)], "src long, dst long, weight double")
    start = R.spectral_start(edges, 2, tolerance=1e-2)
    out = R.layout(edges, start, n_epochs=2).collect()
    assert len(out) == 9 and all(np.isfinite(r.coords).all() for r in out)
    assert plans and not any("ObjectHashAggregate" in p for p in plans)
    assert R.layout(edges, start.filter("id < 0"), n_epochs=2).count() == 0
