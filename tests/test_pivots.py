import numpy as np
import pandas as pd
import pytest

from agora.operators import joins


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clustered(n, seed, d=12, centres=20, spread=0.08):
    rng = np.random.default_rng(99)
    c = _unit(rng.normal(size=(centres, d)))
    rng = np.random.default_rng(seed)
    return _unit(c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d)))


@pytest.mark.parametrize("threshold", [0.0, 0.55, 0.9, 0.999])
def test_all_pairs_above_with_fewer_products(threshold):
    x, y = _clustered(500, 1), _clustered(700, 2)
    y[5] = y[6] = x[3]
    i, j, score, products = joins.Pivots(y).above(x, threshold)
    want = x @ y.T
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(want > threshold))))
    assert np.allclose(score, want[i, j]) and len(set(zip(i.tolist(), j.tolist()))) == len(i)
    if threshold >= 0.9:
        assert products < 0.2 * want.size


def test_vectors_without_structure_lose_no_pair():
    rng = np.random.default_rng(4)
    x, y = _unit(rng.normal(size=(200, 3))), _unit(rng.normal(size=(150, 3)))
    i, j, _, products = joins.Pivots(y).above(x, 0.8)
    assert len(i) == (x @ y.T > 0.8).sum() and products < x.shape[0] * (y.shape[0] + 13)


def test_equal_and_few_vectors():
    one = np.tile(_unit(np.ones((1, 4))), (40, 1))
    around = joins.Pivots(one)
    assert len(around.pivots) == 1 and len(around.above(one[:3], 0.5)[0]) == 120
    odd = np.vstack([one, np.full((1, 4), np.nan)])
    assert len(joins.Pivots(odd).above(odd, 0.5)[0]) == 1600
    few = joins.Pivots(np.eye(4)[:3])
    assert few.above(np.eye(4), 0.5)[:2][0].tolist() == [0, 1, 2]


@pytest.mark.parametrize("block", [4096, 50])
def test_join_with_threshold_is_the_filtered_join(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "RIGHT_BLOCK", block)
    x, y = _clustered(120, 5), _clustered(90, 6)
    left = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 12), (502, [1.0, 2.0])]
    right = [(i, v.tolist()) for i, v in enumerate(y)] + [(600, None), (601, [0.0] * 12), (602, [2.0, 4.0])]
    a = spark.createDataFrame(left, "a long, x array<double>")
    b = spark.createDataFrame(right, "b long, y array<double>")

    def rows(threshold):
        got = joins.similarity_join(a, b, "x", "y", threshold).select("a", "b", "similarity").toPandas()
        return {(r.a, r.b): r.similarity for r in got.itertuples()}
    every = rows(None)
    assert len(every) == len(left) * len(right)
    for threshold in (-0.1, 0.0, 0.7):
        got = rows(threshold)
        # at 0 itself products of other order may differ in the last place
        assert {p for p, v in every.items() if v > threshold + 1e-12} <= set(got) <= {p for p, v in every.items() if v > threshold - 1e-12}
        assert all(abs(every[p] - v) < 1e-9 for p, v in got.items())
