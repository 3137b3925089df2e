import numpy as np
import pytest

from agora.operators import hierarchy as H


def lance_williams(D):
    n = len(D)
    dd = {(i, j): D[i][j] for i in range(n) for j in range(n) if i != j}
    size = {i: 1 for i in range(n)}
    active, nid, out = set(range(n)), n, []
    while len(active) > 1:
        dmin, i, j = min((dd[(a, b)], a, b) for a in active for b in active if a < b)
        out.append((round(dmin, 9), size[i] + size[j]))
        for k in active - {i, j}:
            nk, ni, nj = size[k], size[i], size[j]
            v = np.sqrt(((nk + ni) * dd[(i, k)] ** 2 + (nk + nj) * dd[(j, k)] ** 2 - nk * dmin ** 2) / (ni + nj + nk))
            dd[(nid, k)] = dd[(k, nid)] = v
        size[nid] = size[i] + size[j]
        active -= {i, j}
        active.add(nid)
        nid += 1
    return sorted(out)


@pytest.mark.parametrize("piece", [10**6, 6, 0])
def test_ward_matches_lance_williams(spark, piece):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(9, 4))
    D = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    rows = [(i, j, float(D[i, j])) for i in range(9) for j in range(9)]
    dist = spark.createDataFrame(rows, "a long, b long, distance double")
    m = H.ward_hierarchy(dist, piece).orderBy("step").toPandas()
    got = sorted((round(r.distance, 9), int(r.size)) for r in m.itertuples())
    assert got == lance_williams(D.tolist())
    assert list(m.distance) == sorted(m.distance)
    assert sorted(m.topics.iloc[-1]) == list(range(9))
    cut = H.hierarchy_cut(spark.createDataFrame(m), 9, 3).toPandas()
    assert cut.cluster.nunique() == 3


def test_long_chain_is_complete(spark):
    """Points on a line with growing gaps merge one by one: no round or depth is cut off."""
    n = 120
    x = np.cumsum(np.arange(n) ** 1.5)
    rows = [(i, j, float(abs(x[i] - x[j]))) for i in range(n) for j in range(n)]
    m = H.ward_hierarchy(spark.createDataFrame(rows, "a long, b long, distance double")).toPandas()
    assert len(m) == n - 1 and max(map(len, m.topics)) == n


def test_levels_and_reduction(spark):
    merges = spark.createDataFrame([(1, 4, [0, 1], 1.0), (2, 5, [2, 3], 2.0), (3, 6, [0, 1, 2, 3], 3.0)],
                                   "step int, parent long, topics array<long>, distance double")
    docs = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 2), (6, -1)], "doc_id long, topic long")
    got = {(r["doc_id"], r["level"]): r["topic"] for r in H.document_hierarchy(merges, docs).collect()}
    want = {0: [0, 1, 2, 3, 2, -1], 1: [4, 4, 2, 3, 2, -1], 2: [4, 4, 5, 5, 5, -1], 3: [6, 6, 6, 6, 6, -1]}
    assert got == {(i + 1, lv): t for lv, ts in want.items() for i, t in enumerate(ts)}
    mapping, new = H.reduce_topics(merges, docs, 4, 2)
    assert {tuple(r) for r in mapping.collect()} == {(0, 1), (1, 1), (2, 0), (3, 0), (-1, -1)}
    assert {tuple(r) for r in new.collect()} == {(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, -1)}
