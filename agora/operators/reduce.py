"""Dimension reduction.

Linear reductions (PCA, fixed random projection) are row-local after the
fit. The neighbour-graph layout follows the UMAP recipe as DataFrame
rounds: per-point bandwidths by bisection inside the row (D9), a fuzzy
union of the directed kNN graph (D10) and full-batch epochs of edge
attraction plus repulsion from nodes sampled by hash (D11). The layout is
approximate (no bit parity with any single-machine implementation).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import knn as K
from agora.operators import vectors as VO
from agora.session import write_shared


def smooth_knn(knn: DataFrame, k: int | None = None, n_iter: int = 64, tol: float = 1e-5) -> DataFrame:
    """``(id, rho, sigma)`` — rho = nearest positive distance; sigma
    solves Σ_j exp(−max(0, d_j − rho)/sigma) = log2(k) by bisection (64
    steps inside the row over the point's ≤ k distances)."""
    g = knn.groupBy("src").agg(F.collect_list("distance").alias("ds"))
    kk = F.size("ds") if k is None else F.lit(k)
    target = F.log2(kk.cast("double"))
    rho = F.coalesce(F.array_min(F.filter("ds", lambda x: x > 0)), F.lit(0.0))
    g = g.select("src", "ds", rho.alias("rho"), target.alias("target"))

    def psum(sig):
        return F.aggregate("ds", F.lit(0.0),
                           lambda a, d: a + F.exp(-F.greatest(d - F.col("rho"), F.lit(0.0)) / sig))

    init = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"),
                    F.lit(False).alias("done"))

    def step(s, _i):
        p = psum(s["mid"])
        done = s["done"] | (F.abs(p - F.col("target")) < tol)
        hi = F.when(done, s["hi"]).when(p > F.col("target"), s["mid"]).otherwise(s["hi"])
        lo = F.when(done, s["lo"]).when(p > F.col("target"), s["lo"]).otherwise(s["mid"])
        mid = F.when(done, s["mid"]).when(p > F.col("target"), (s["lo"] + s["mid"]) / 2) \
            .otherwise(F.when(F.isnan(s["hi"]) | (s["hi"] == float("inf")), s["mid"] * 2).otherwise((s["mid"] + s["hi"]) / 2))
        return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), done.alias("done"))

    res = F.aggregate(F.sequence(F.lit(1), F.lit(n_iter)), init, lambda s, i: step(s, i))
    return g.select(F.col("src").alias("id"), "rho", res["mid"].alias("sigma"))


def fuzzy_graph(knn: DataFrame, smooth: DataFrame) -> DataFrame:
    """Directed memberships w = exp(−max(0, d − rho_src)/sigma_src),
    then the fuzzy union a + b − a·b over (i,j)/(j,i) → ``(src, dst,
    weight)`` with src < dst."""
    s = smooth.select(F.col("id").alias("src"), "rho", "sigma")
    w = knn.join(s, "src").select("src", "dst", F.exp(-F.greatest(F.col("distance") - F.col("rho"), F.lit(0.0))
                                                      / F.col("sigma")).alias("w"))
    a = w.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"),
                 F.when(F.col("src") < F.col("dst"), F.col("w")).alias("wa"),
                 F.when(F.col("src") > F.col("dst"), F.col("w")).alias("wb"))
    u = a.groupBy("i", "j").agg(F.coalesce(F.max("wa"), F.lit(0.0)).alias("a"),
                                F.coalesce(F.max("wb"), F.lit(0.0)).alias("b"))
    return u.select(F.col("i").alias("src"), F.col("j").alias("dst"),
                    (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def _summed(rows: DataFrame, entries: list, out: str) -> DataFrame:
    """``(id, out)``: arrays of the sums of ``entries`` per id, a plain sum for each, which
    is compiled, where an aggregate of arrays makes objects of every row."""
    sums = rows.groupBy("id").agg(*[F.sum(x).alias(f"_{j}") for j, x in enumerate(entries)])
    return sums.select("id", F.array(*[F.col(f"_{j}") for j in range(len(entries))]).alias(out))


def spectral_start(graph: DataFrame, k: int, more: int = 8, degree: int = 12, tolerance: float = 1e-6,
                   seed: int = 0) -> DataFrame:
    """``(id, coords)``: for each node of a graph ``(src, dst, weight)`` (an edge once) its
    entries in the eigenvectors 2 … k + 1 of the symmetric normalised Laplacian, by
    ascending eigenvalue. The first eigenvector holds no more than the degrees.

    ``k + 1 + more`` random vectors, a short array per node, pass Chebyshev filters of
    ``degree`` sparse products (a join with the edges and a sum per node), which damp
    what lies below the block's smallest Ritz value; then the block is made orthonormal
    and turned to its Ritz vectors. Only products of block columns reach the driver. It
    ends when ‖Mx − θx‖ is at most ``tolerance`` for all wanted vectors, or has not
    fallen in three rounds. Vectors are unique up to sign; in a graph of several
    components those of eigenvalue 0 are some basis. A graph of too few nodes has zeros
    in the places that are left; one without edges has no row."""
    both = graph.select("src", "dst", "weight").filter("src <> dst and weight > 0")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    deg = write_shared(both.groupBy("src").agg(F.sum("weight").alias("degree")), "degrees")
    n = deg.count()
    if n == 0:
        return deg.select(F.col("src").alias("id"), F.array().cast("array<double>").alias("coords"))
    near = write_shared(both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("degree").alias("other")), "dst")
                        .select("src", "dst", (F.col("weight") / F.sqrt(F.col("degree") * F.col("other"))).alias("m")), "near")

    def times(x: DataFrame, col: str) -> DataFrame:
        """``(id, my)``: the normalised adjacency times a block of ``width`` columns."""
        v = x.select(F.col("id").alias("dst"), F.col(col).alias("v"))
        return _summed(near.join(v, "dst").select(F.col("src").alias("id"), "m", "v"),
                       [F.get("v", F.lit(j)) * F.col("m") for j in range(width)], "my")

    width = min(n, k + 1 + more)
    start = [F.xxhash64("src", F.lit(j), F.lit(seed)) / 2.0**63 for j in range(width)]
    y = write_shared(deg.select(F.col("src").alias("id"), F.array(*start).alias("y")), "block")
    best, stalled = np.inf, 0
    while True:
        y = write_shared(y.join(times(y, "y"), "id"), "block")
        gram, _, _ = VO._gram_times(y.select(F.concat("y", "my").alias("v")), np.eye(2 * width))
        yy, ym, mm = gram[:width, :width], gram[:width, width:], gram[width:, width:]
        scale = 1 / np.sqrt(np.maximum(np.diag(yy), np.finfo(float).tiny))
        values, turn = np.linalg.eigh(yy * np.outer(scale, scale))
        whole = values > values[-1] * 1e-10
        white = scale[:, None] * turn[:, whole] / np.sqrt(values[whole])
        theta, u = np.linalg.eigh(white.T @ (ym + ym.T) / 2 @ white)
        theta, c = theta[::-1], (white @ u)[:, ::-1]
        rest = np.einsum("ij,ik,kj->j", c, mm, c) - theta**2  # ‖Mx − θx‖² of orthonormal x
        worst = float(np.sqrt(np.maximum(rest[: k + 1], 0).max()))
        stalled = 0 if worst < 0.9 * best else stalled + 1
        best = min(best, worst)
        x = VO.project(y.select("id", "y", "my"), c.T, "y", "now")
        if worst <= tolerance or stalled == 3 or width == n:
            break
        # filter: what has eigenvalues from −1 to the smallest Ritz value is damped
        width = len(theta)
        low = float(np.clip(theta[-1], -0.5, 0.99))
        mid, half = (low - 1) / 2, (low + 1) / 2
        x = VO.project(x, c.T, "my", "m_now")
        state = write_shared(x.select("id", F.col("now").alias("before"), F.zip_with(
            "m_now", "now", lambda m, v: (m - mid * v) / half).alias("now")), "filtered")
        for _ in range(degree - 1):
            state = write_shared(state.join(times(state, "now"), "id").select("id", F.col("now").alias("before"), F.zip_with(
                F.zip_with("my", "now", lambda m, v: 2 * (m - mid * v) / half), "before", lambda a, b: a - b).alias("now")),
                "filtered")
        y = state.select("id", F.col("now").alias("y"))
    missing = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), k - F.size("c")))
    return write_shared(x.select("id", F.slice("now", 2, k).alias("c")).select(
        "id", F.concat("c", missing).alias("coords")), "spectral")


#: The low-dimensional similarity 1 / (1 + A d^(2B)), for a least distance of 0.1.
CURVE_A, CURVE_B = 1.577, 0.895
_CLIP = 4.0


def layout(graph: DataFrame, init: DataFrame, n_epochs: int = 50, lr: float = 1.0,
           negatives: int = 5, seed: int = 0) -> DataFrame:
    """``(id, coords)``. Each epoch every node is pulled along its edges, by
    the gradient of the similarity curve times the edge's weight, and pushed away
    from ``negatives`` samples per unit of edge weight: nodes fall into as many
    hash buckets as there are nodes, and each node draws buckets by hash anew in
    every epoch. Forces are summed map-side; steps shrink linearly. Positions are
    written once per epoch."""
    pos = write_shared(init.select("id", F.col("coords").cast("array<double>").alias("y")), "positions")
    n, dims = pos.agg(F.count(F.lit(1)), F.max(F.size("y"))).first()
    if not n:
        return pos.select("id", F.col("y").alias("coords"))
    axes = range(dims)
    # positions start within a box of side 10
    top = pos.select(F.max(F.array_max(F.transform("y", lambda v: F.abs(v)))).alias("m"))
    pos = pos.join(F.broadcast(top)).select("id", F.transform(
        "y", lambda v: v * 10.0 / F.greatest(F.col("m"), F.lit(1e-9))).alias("y"))
    e = graph.select("src", "dst", "weight")
    e = write_shared(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "edges")
    degree = write_shared(e.groupBy("src").agg(F.sum("weight").alias("degree")), "degree")
    bucket = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))

    def forces(rows: DataFrame, coefficient) -> DataFrame:
        """``rows``: src, a (own position), b (the other's), weight. A column per dimension."""
        apart = rows.select(F.col("src").alias("id"), "weight", *[(F.get("a", F.lit(j)) - F.get("b", F.lit(j))).alias(f"x{j}") for j in axes])
        d2 = sum((F.col(f"x{j}") * F.col(f"x{j}") for j in axes), F.lit(0.0))
        c = apart.withColumn("d2", d2).withColumn("c", coefficient(F.col("d2")) * F.col("weight"))
        return c.select("id", *[F.least(F.greatest(F.col("c") * F.col(f"x{j}"), F.lit(-_CLIP)), F.lit(_CLIP)).alias(f"f{j}") for j in axes])

    def pull(d2):
        return F.when(d2 > 0, -2 * CURVE_A * CURVE_B * F.pow(d2, CURVE_B - 1) / (1 + CURVE_A * F.pow(d2, CURVE_B))).otherwise(0.0)

    def push(d2):
        return 2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * F.pow(d2, CURVE_B)))

    for epoch in range(n_epochs):
        alpha = lr * (1.0 - epoch / n_epochs)
        own = pos.select(F.col("id").alias("src"), F.col("y").alias("a"))
        other = pos.select(F.col("id").alias("dst"), F.col("y").alias("b"))
        attraction = forces(e.join(own, "src").join(other, "dst"), pull)
        draws = F.explode(F.sequence(F.lit(1), F.lit(negatives)))
        drawn = own.join(degree, "src").withColumn("draw", draws).withColumn(
            "bucket", F.pmod(F.xxhash64("src", "draw", F.lit(epoch), F.lit(seed + 1)), F.lit(n)))
        repulsion = forces(
            drawn.join(pos.select(bucket.alias("bucket"), F.col("id").alias("dst"), F.col("y").alias("b")), "bucket")
            .filter("src <> dst").withColumn("weight", F.col("degree")), push)
        total = _summed(attraction.unionByName(repulsion), [F.col(f"f{j}") for j in axes], "f")
        pos = write_shared(pos.join(total, "id", "left").select("id", F.when(F.col("f").isNull(), F.col("y")).otherwise(
            F.zip_with("y", "f", lambda v, f: v + alpha * f)).alias("y")), "positions")
    return pos.select("id", F.col("y").alias("coords"))


def trustworthiness(near: DataFrame, ranks: DataFrame, n: int, k: int) -> DataFrame:
    """How far the ``k`` neighbours in a layout (``near``: src, dst) are neighbours
    in the original space too (``ranks``: src, dst, rank): 1 less the normalised
    sum of rank - k over those that are not."""
    late = near.select("src", "dst").join(ranks, ["src", "dst"]).agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0))).alias("late"))
    return late.select((1 - F.col("late") * 2 / (n * k * (2 * n - 3 * k - 1))).alias("trustworthiness"))


def reduce(df: DataFrame, method: str = "pca", n_components: int = 50, n_neighbors: int = 15,
           metric: str = "cosine", id_col: str = "doc_id", vec_col: str = "embedding", seed: int = 0,
           n_epochs: int = 50, dim: int | None = None, graph: str = "exact",
           coords: DataFrame | None = None, start: str = "spectral") -> DataFrame:
    """``(id, coords)`` by ``pca`` | ``random`` | ``umap`` (neighbour graph →
    D9 → D10 → D11 from a ``spectral`` or ``pca`` start) | ``given``: the rows of ``coords`` ``(id,
    coords)``, reduced elsewhere, for the ids of ``df``. ``graph`` is ``exact`` or
    ``lsh``. Chain calls to reduce a reduction further (e.g. to 3-D)."""
    ids = df.select(F.col(id_col).alias("id"))
    if method == "given":
        if coords is None:
            raise ValueError("method 'given' needs coords")
        return coords.join(ids, "id", "left_semi").select("id", "coords")
    if method == "pca":
        out = VO.pca(df.select(id_col, vec_col), n_components, vec_col, "coords")
        return out.select(F.col(id_col).alias("id"), "coords")
    if method == "random":
        d = dim if dim is not None else df.select(F.size(vec_col)).first()[0]
        out = VO.random_projection(df.select(id_col, vec_col), d, n_components, seed, vec_col, "coords")
        return out.select(F.col(id_col).alias("id"), "coords")
    if method == "umap":
        find = {"exact": K.knn_exact, "lsh": K.knn_lsh}[graph]
        kn = write_shared(find(df, n_neighbors, id_col, vec_col, metric), "knn")
        fuzzy = write_shared(fuzzy_graph(kn, smooth_knn(kn, n_neighbors)), "fuzzy")
        if start == "spectral":
            # epochs move every node further than this error of a start
            place = spectral_start(fuzzy, n_components, tolerance=1e-2, seed=seed)
            top = place.agg(F.max(F.array_max(F.transform("coords", lambda v: F.abs(v)))).alias("top"))
            # nodes of one component may share a place: a ten-thousandth of noise
            noise = [F.xxhash64("id", F.lit(j), F.lit(seed + 2)) / 2.0**63 * 1e-4 for j in range(n_components)]
            zeros = F.array_repeat(F.lit(0.0), n_components)
            init = ids.join(place, "id", "left").join(F.broadcast(top)).select("id", F.zip_with(
                F.coalesce("coords", zeros), F.array(*noise),
                lambda v, e: v / F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(1e-12)) + e).alias("coords"))
        elif start == "pca":
            init = VO.pca(df.select(id_col, vec_col), n_components, vec_col, "coords") \
                .select(F.col(id_col).alias("id"), "coords")
        else:
            raise ValueError(f"unknown start {start}")
        return layout(fuzzy, init, n_epochs, seed=seed)
    raise ValueError(f"unknown method {method}")
