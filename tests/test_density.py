import heapq

import numpy as np
import pandas as pd
import pytest

from agora.operators import density as D
from agora.operators import dendrogram, forest


def blobs(seed=7, per=40, centers=((0, 0), (8, 0), (0, 8)), noise=12, spread=12):
    rng = np.random.default_rng(seed)
    pts = [rng.normal(c, 0.5, size=(per, 2)) for c in centers]
    pts.append(rng.uniform(-4, spread, size=(noise, 2)))
    x = np.vstack(pts)
    truth = np.concatenate([np.full(per, i) for i in range(len(centers))] + [np.full(noise, -1)])
    return x, truth


def frame(spark, x):
    pdf = pd.DataFrame({"doc_id": np.arange(len(x)), "embedding": [r.tolist() for r in x]})
    return spark.createDataFrame(pdf, "doc_id long, embedding array<double>")


def prim_weight(n, edges):
    adj = {i: [] for i in range(n)}
    for s, d, w in edges:
        adj[s].append((w, d))
        adj[d].append((w, s))
    seen, total = set(), 0.0
    for start in range(n):
        if start in seen:
            continue
        h = [(0.0, start)]
        while h:
            w, u = heapq.heappop(h)
            if u in seen:
                continue
            seen.add(u)
            total += w
            for e in adj[u]:
                if e[1] not in seen:
                    heapq.heappush(h, e)
    return total


def plain_condensed(n, edges, mcs):
    """Level by level over all distinct weights, straight from the definition."""
    def comps(points, eps):
        parent = {p: p for p in points}

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a
        for s, d, w in edges:
            if w <= eps and s in parent and d in parent:
                parent[find(s)] = find(d)
        out = {}
        for p in points:
            out.setdefault(find(p), []).append(p)
        return [sorted(c) for c in out.values()]

    clusters, fell = [], {}

    def walk(points, birth, parent, weights):
        key = (birth, points[0], len(points))
        clusters.append([key, parent, 0.0])
        me, here = clusters[-1], points
        for at, w in enumerate(weights):
            lam = 1 / w if w > 0 else float("inf")
            parts = comps(here, below[w])
            large = [c for c in parts if len(c) >= mcs]
            for p in (p for c in parts if len(c) < mcs for p in c):
                fell[p] = (key, lam)
                me[2] += lam - birth if lam != birth else 0.0
            if len(large) == 1:
                here = large[0]
                continue
            for c in large:
                me[2] += len(c) * (lam - birth)
                walk(c, lam, key, weights[at + 1:])
            return

    all_weights = sorted({w for _, _, w in edges}, reverse=True)
    below = {w: (all_weights[i + 1] if i + 1 < len(all_weights) else -1.0) for i, w in enumerate(all_weights)}
    trees = comps(range(n), float("inf"))
    large = [t for t in trees if len(t) >= mcs]
    for t in trees:
        if len(t) < mcs:
            for p in t:
                fell[p] = ("root", 0.0)
    if len(large) == 1:
        walk(large[0], 0.0, None, all_weights)
    else:
        for t in large:
            walk(t, 0.0, "root", all_weights)
    return clusters, fell


def graph(rng, n, k, ties):
    edges = set()
    for i in range(n):
        for j in rng.choice(n, k, replace=False).tolist():
            if i != j and (i // 25 == j // 25 or rng.random() < 0.02):
                edges.add((min(i, j), max(i, j)))
    w = rng.integers(0, 12, len(edges)) / 4.0 if ties else rng.random(len(edges)) + 0.01
    return [(s, d, float(x)) for (s, d), x in zip(sorted(edges), w)]


@pytest.mark.parametrize("ties,piece", [(False, 10**6), (False, 12), (True, 10**6), (True, 12)])
def test_forest_and_tree_by_definition(spark, ties, piece):
    n, mcs = 110, 5
    edges = graph(np.random.default_rng(1 + ties), n, 6, ties)
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    mst = D.minimum_spanning_forest(df, piece=piece)
    rows = [tuple(r) for r in mst.collect()]
    assert abs(sum(r[2] for r in rows) - prim_weight(n, edges)) < 1e-9
    check_tree(n, mcs, rows, *forest.condensed_tree(mst, nodes, mcs, piece=piece))


def check_tree(n, mcs, rows, clusters, members):
    want, fell = plain_condensed(n, rows, mcs)
    got = clusters.toPandas()
    sizes = sorted((round(b, 9), s) for b, s in zip(got["birth"], got["size"]) if np.isfinite(b))
    roots = [] if any(c[1] is None for c in want) else [(0.0, n)]
    mine = sorted([(round(c[0][0], 9), n if c[1] is None else c[0][2]) for c in want if np.isfinite(c[0][0])] + roots)
    assert sizes == mine
    leave = {r["node"]: r["leave"] for r in members.collect()}
    assert len(leave) == n and all(leave[p] == pytest.approx(lam) for p, (_, lam) in fell.items())
    finite = sorted(round(m, 6) for m in got.loc[got.parent.notna(), "stability"] if np.isfinite(m))
    plain = sorted(round(c[2], 6) for c in want if c[1] is not None and np.isfinite(c[2]))
    assert finite == plain


@pytest.mark.parametrize("ties", [False, True])
def test_contracted_tree_by_definition(spark, ties):
    n, mcs = 110, 5
    edges = graph(np.random.default_rng(1 + ties), n, 6, ties)
    mst = D.minimum_spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight double"))
    nodes = spark.range(n).withColumnRenamed("id", "node")
    check_tree(n, mcs, [tuple(r) for r in mst.collect()], *D.condensed_tree(mst, nodes, mcs))


def plain_merges(edges):
    """(weight, size, smallest point) of each merge, edges of equal weight at once."""
    comp, out = {}, []
    for w in sorted({e[2] for e in edges}):
        grown = {}
        for s, d, _ in (e for e in edges if e[2] == w):
            a, b = comp.setdefault(s, frozenset([s])), comp.setdefault(d, frozenset([d]))
            for p in a | b:
                comp[p] = a | b
            grown.pop(a, None), grown.pop(b, None)
            grown[a | b] = True
        out += [(w, len(c), min(c)) for c in grown]
    return sorted(out)


SHAPES = {
    "path": [(i, i + 1, float(i % 7 + 1)) for i in range(40)],
    "rising path": [(i, i + 1, float(i)) for i in range(40)],
    "star": [(0, i, float(i)) for i in range(1, 40)],
    "equal star": [(0, i, 2.0) for i in range(1, 40)],
    "two trees": [(0, 1, 0.0), (1, 2, 3.0), (10, 11, 1.0)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_merge_tree_by_definition(spark, shape):
    edges = SHAPES[shape]
    tree, points = dendrogram.merge_tree(spark.createDataFrame(edges, "src long, dst long, weight double"))
    rows = {r.node: r for r in tree.collect()}
    weight = {n: r.weight for n, r in rows.items()}
    tops = [r for r in rows.values() if weight.get(r.parent) != r.weight]
    assert sorted((r.weight, r.size, r.least) for r in tops) == plain_merges(edges)
    # a point joins at its lightest edge, and weights rise on the way up
    lightest = {}
    for s, d, w in edges:
        lightest[s], lightest[d] = min(w, lightest.get(s, w)), min(w, lightest.get(d, w))
    assert {r.point: weight[r.node] for r in points.collect()} == lightest
    assert all(r.parent is None or weight[r.parent] >= r.weight for r in rows.values())


def test_condensed_tree_of_few_points(spark):
    schema = "src long, dst long, weight double"
    nodes = spark.range(4).withColumnRenamed("id", "node")
    for edges in ([], [(0, 1, 1.0)]):
        clusters, members = D.condensed_tree(spark.createDataFrame(edges, schema), nodes, 3)
        assert [tuple(r) for r in clusters.collect()] == [("root", None, 0.0, 0.0, 4)]
        assert sorted(map(tuple, members.collect())) == [(i, "root", 0.0) for i in range(4)]


def test_contraction_has_no_group_of_all(spark):
    mst = spark.createDataFrame(SHAPES["path"], "src long, dst long, weight double")
    tree, _ = dendrogram.merge_tree(mst)
    clusters, members = D.condensed_tree(mst, spark.range(41).withColumnRenamed("id", "node"), 3)
    for df in (tree, clusters, members):
        plan = df._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("piece", [10**6, 7])
def test_components_of_long_paths(spark, piece):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 9, 9), (1, 5, 4)] + [(1, i, i + 1) for i in range(30, 60)],
                                  "g long, a long, b long")
    got = {(r["g"], r["node"]): r["root"] for r in forest.components(edges, ["g"], piece).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 9): 9, (1, 4): 4, (1, 5): 4, **{(1, i): 30 for i in range(30, 61)}}


def test_density_cluster_finds_blobs(spark):
    x, truth = blobs()
    out = D.density_cluster(frame(spark, x), min_cluster_size=10, min_samples=3, k_graph=10)
    lab = out["labels"].toPandas().sort_values("id")
    assert lab[lab.cluster != -1].cluster.nunique() == 3
    core = lab.cluster.to_numpy()[:120]
    for b in range(3):
        vals = core[b * 40:(b + 1) * 40]
        vals = vals[vals != -1]
        assert len(set(vals)) == 1 and len(vals) >= 30
    assert -1.0 <= D.relative_validity(out["mst"], out["labels"]).first()["validity"] <= 1.0
    assert 0.0 <= D.noise_ratio(out["labels"]).first()["noise_ratio"] < 0.3


def test_far_apart_blobs_in_a_disconnected_graph(spark):
    """Each blob is a tree of its own and never splits: both are still found."""
    x, _ = blobs(per=30, centers=((0, 0), (1000, 0)), noise=0)
    lab = D.density_cluster(frame(spark, x), min_cluster_size=12, min_samples=3, k_graph=8)["labels"].toPandas()
    lab = lab.sort_values("id").cluster.to_numpy()
    assert len(set(lab[:30]) - {-1}) == 1 and len(set(lab[30:]) - {-1}) == 1 and set(lab[:30]) != set(lab[30:])
    assert (lab == -1).sum() < 6


TREE = [("r", None, 0.0, 1.0), ("a", "r", 1.0, 5.0), ("b", "r", 1.0, 2.0), ("a1", "a", 2.0, 1.0), ("a2", "a", 2.0, 1.0),
        ("b1", "b", 2.0, 2.0), ("b2", "b", 2.0, 1.0), ("b11", "b1", 3.0, 1.0), ("b12", "b1", 3.0, 0.5)]


@pytest.mark.parametrize("piece", [10**6, 3])
def test_selection_fixed_tree(spark, piece):
    cl = spark.createDataFrame(TREE, "cluster string, parent string, birth double, stability double")
    assert sorted(r.cluster for r in D.select_leaf(cl).collect()) == ["a1", "a2", "b11", "b12", "b2"]
    assert sorted(r.cluster for r in D.select_eom(cl, piece=piece).collect()) == ["a", "b1", "b2"]
    assert sorted(r.cluster for r in D.select_eom(cl, True, piece=piece).collect()) == ["a", "b1", "b2"]
    heavy = spark.createDataFrame([("r", None, 0.0, 20.0), *TREE[1:]],
                                  "cluster string, parent string, birth double, stability double")
    assert [r.cluster for r in D.select_eom(heavy, True, piece=piece).collect()] == ["r"]
    roots = spark.createDataFrame([("r", None, 0.0, 0.0), ("x", "r", 0.0, 5.0), ("y", "r", 0.0, 4.0)],
                                  "cluster string, parent string, birth double, stability double")
    assert sorted(r.cluster for r in D.select_eom(roots, piece=piece).collect()) == ["x", "y"]


def test_labels_fixed_tree(spark):
    cl = spark.createDataFrame(TREE, "cluster string, parent string, birth double, stability double")
    members = spark.createDataFrame([(1, "r"), (2, "a"), (3, "a1"), (4, "b"), (5, "b11"), (6, "b12"), (7, "b2"), (8, "a2")],
                                    "node long, cluster string")
    nodes = spark.range(1, 10).withColumnRenamed("id", "node")
    chosen = spark.createDataFrame([("a",), ("b1",), ("b2",)], "cluster string")
    got = {r["id"]: r["cluster"] for r in D.cluster_labels(cl, members, chosen, nodes).collect()}
    assert got == {1: -1, 2: 0, 3: 0, 4: -1, 5: 1, 6: 1, 7: 2, 8: 0, 9: -1}


def test_components_at(spark):
    mst = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (2, 3, 1.0)], "src long, dst long, weight double")
    nodes = spark.range(5).withColumnRenamed("id", "node")
    assert {r.node: r.comp for r in D.components_at(mst, 2.0, nodes).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_sweep_and_refit(spark):
    x, _ = blobs(per=30, noise=6)
    df = frame(spark, np.hstack([x, np.zeros((len(x), 2)) + 0.01 * np.arange(len(x))[:, None] % 1]))
    space = {"n_neighbors": (6, 12, 3), "n_components": (1, 3, 1), "min_cluster_size": (5, 20, 5), "min_samples": (1, 4, 1)}
    trials, labels = D.sweep_with_labels(df, space, 6)
    t = trials.toPandas()
    assert len(t) == 6 and labels.count() == 6 * len(x)
    assert np.allclose(t.score, -t.validity + D.SWEEP_ALPHA * t.noise_ratio)
    one = t.sort_values(["score", "trial"]).iloc[0]
    best, lab = D.fit_best(df, space, 6)
    assert best.first()["trial"] == one.trial
    # the same parameters alone give the same labels
    from agora.operators import vectors as VO
    from pyspark.sql import functions as F
    pc = VO.pca(df.select(F.col("doc_id"), "embedding"), 3, "embedding", "embedding").withColumn(
        "embedding", F.slice("embedding", 1, int(one.n_components)))
    alone = D.density_cluster(pc, int(one.min_cluster_size), int(one.min_samples),
                              k_graph=max(int(one.n_neighbors), int(one.min_samples)))["labels"]
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, lab.select("id", "cluster").collect()))
