import numpy as np
import pytest

import __spark_entry__ as E
from agora.operators import density as D
from agora.operators import forest, knn, span
from agora.sources import fixtures as fx
from tests.conftest import SF
from tests.test_density import blobs, frame


def plain_tree(x, k, metric):
    """Prim's tree over the whole matrix of mutual-reachability distances."""
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    best, seen, out = w[0].copy(), np.zeros(len(x), bool), []
    seen[0] = True
    for _ in range(len(x) - 1):
        best[seen] = np.inf
        j = int(best.argmin())
        out.append(best[j])
        seen[j] = True
        best = np.minimum(best, w[j])
    return sorted(out)


def tree(df, k, lists, metric, **settings):
    near = knn.knn_exact(df, lists, metric=metric)
    return span.spanning_tree(df, near, D.core_distance(near, k), metric=metric, **settings)


@pytest.mark.parametrize("metric,block", [("euclidean", 4096), ("cosine", 40)])
def test_tree_of_all_pairs(spark, metric, block):
    """Far blobs, whose neighbour lists never leave them: one tree all the same."""
    x, _ = blobs(per=35, centers=((3, 3), (100, 5), (4, 90)), noise=9)
    df = frame(spark, x)
    got = tree(df, 3, 5, metric, block_rows=block).toPandas()
    assert len(got) == len(x) - 1
    assert np.allclose(sorted(got.weight), plain_tree(x, 3, metric), atol=1e-8)
    edges = spark.createDataFrame(got).selectExpr("src as a", "dst as b")
    assert forest.components(edges).select("root").distinct().count() == 1


def test_tree_of_embeddings(spark):
    df = fx.vectors(spark, SF["0.01"])
    rows = df.orderBy("doc_id").collect()
    got = E.queries()["spanning_tree"](spark, SF["0.01"]).toPandas()
    assert len(got) == len(rows) - 1
    want = plain_tree(np.array([r["embedding"] for r in rows], float), 3, "cosine")
    assert np.allclose(sorted(got.weight), want, atol=2e-6)


def test_tree_with_ties_and_few_rows(spark):
    x = np.array([[0.0, 0.0]] * 6 + [[1.0, 0.0]] * 4 + [[5.0, 5.0]])
    got = tree(frame(spark, x), 1, 2, "euclidean", block_rows=3).toPandas()
    assert len(got) == 10 and np.allclose(sorted(got.weight), plain_tree(x, 1, "euclidean"), atol=1e-8)
    assert tree(frame(spark, x[:1]), 1, 2, "euclidean").count() == 0


def test_density_clusters_over_one_tree(spark):
    x, _ = blobs(per=30, centers=((0, 0), (1000, 0)), noise=0)
    out = D.density_cluster(frame(spark, x), min_cluster_size=12, min_samples=3, k_graph=8, span="all")
    assert out["mst"].count() == len(x) - 1
    lab = out["labels"].toPandas().sort_values("id").cluster.to_numpy()
    assert len(set(lab[:30]) - {-1}) == 1 and len(set(lab[30:]) - {-1}) == 1 and set(lab[:30]) != set(lab[30:])
