"""Density clustering over a kNN graph (E1–E14), HDBSCAN*-style.

    kNN → core distance → mutual-reachability edges → minimum spanning
    forest → condensed tree (exact at every distinct weight) → excess-of-mass
    or leaf selection → labels.

``key`` columns keep independent clusterings apart — the trials of a parameter
search are solved together, keyed by trial. The graph machinery is in
:mod:`agora.operators.forest`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.constants import NOISE, SWEEP_ALPHA
from agora.operators import dendrogram, forest
from agora.operators.knn import knn_exact, knn_lsh
from agora.session import write_shared


# ---------------------------------------------------------------- E1, E2 --

def core_distance(knn: DataFrame, min_samples, key: list[str] | None = None) -> DataFrame:
    """Distance to the ``min_samples``-th neighbour (self excluded); a number
    or a column of ``knn``."""
    want = F.lit(min_samples) if isinstance(min_samples, int) else min_samples
    return knn.where(F.col("rank") == want).select(*(key or []), F.col("src").alias("id"),
                                                   F.col("distance").alias("core"))


def mutual_reachability(knn: DataFrame, core: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Undirected kNN edges ``(src < dst)`` weighted by
    max(core_src, core_dst, d)."""
    key = list(key or [])
    e = knn.select(*key, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance") \
        .groupBy(*key, "src", "dst").agg(F.min("distance").alias("distance"))
    cs = core.select(*key, F.col("id").alias("src"), F.col("core").alias("cs"))
    cd = core.select(*key, F.col("id").alias("dst"), F.col("core").alias("cd"))
    return e.join(cs, [*key, "src"]).join(cd, [*key, "dst"]).select(
        *key, "src", "dst", F.greatest("distance", "cs", "cd").alias("weight"))


# ------------------------------------------------------- forest, tree --

def minimum_spanning_forest(edges: DataFrame, key: list[str] | None = None, piece: int = forest.PIECE) -> DataFrame:
    """``(src, dst, weight)`` of a minimum spanning forest (a tree per
    connected component of the kNN graph), ties by endpoints."""
    return forest.spanning_forest(edges, key, piece)


def components_at(mst: DataFrame, eps, nodes: DataFrame, key: list[str] | None = None,
                  piece: int = forest.PIECE) -> DataFrame:
    """``(node, comp)`` — connected components of the forest edges with
    weight ≤ eps, a number or a column of ``mst`` (comp = smallest member id)."""
    key = list(key or [])
    bound = F.lit(eps) if isinstance(eps, (int, float)) else eps
    near = mst.where(F.col("weight") <= bound).select(*key, F.col("src").alias("a"), F.col("dst").alias("b"))
    comp = forest.components(near, key, piece)
    return nodes.join(comp, [*key, "node"], "left").select(
        *key, "node", F.coalesce("root", "node").alias("comp"))


def condensed_tree(mst: DataFrame, nodes: DataFrame, min_cluster_size, key: list[str] | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """E5: ``clusters`` and ``members``. One forest goes by parallel contraction; with
    ``key``, many small forests (the trials of a search) are solved key by key."""
    if key:
        return forest.condensed_tree(mst, nodes, min_cluster_size, key)
    return dendrogram.condensed_tree(mst, nodes, min_cluster_size)


def _eom(key: list[str], allow_single_cluster: bool):
    """Choice for one tree: bottom-up best mass, top-down first choices."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mass = dict(zip(pdf["cluster"], pdf["stability"]))
        parent = {c: p for c, p in zip(pdf["cluster"], pdf["parent"]) if isinstance(p, str)}
        kids: dict[str, list[str]] = {}
        for c, p in parent.items():
            kids.setdefault(p, []).append(c)
        order = [c for c in mass if c not in parent]
        for c in order:  # grows while it is read: parents before children
            order += kids.get(c, [])
        best, keep = {}, set()
        for c in reversed(order):
            below = sum(best[k] for k in kids.get(c, []))
            root = c not in parent
            if (mass[c] >= below or c not in kids) and (allow_single_cluster or not root):
                keep.add(c)
                best[c] = mass[c]
            else:
                best[c] = below
        chosen, blocked = [], set()
        for c in order:
            if parent.get(c) in blocked:
                blocked.add(c)
            elif c in keep:
                chosen.append(c)
                blocked.add(c)
        out = pd.DataFrame({"cluster": pd.Series(chosen, dtype=object)})
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[[*key, "cluster"]]
    return run


def select_eom(clusters: DataFrame, allow_single_cluster: bool = False, key: list[str] | None = None,
               piece: int = forest.PIECE) -> DataFrame:
    """Excess of mass: a cluster is kept when its stability is at least the
    sum of its children's best; the root only with the flag. Returns the kept
    clusters that have no kept cluster above them.

    Trees of more than ``piece`` clusters are lightened first: in rounds, every
    cluster whose children are all decided is decided and leaves the tree."""
    key = list(key or [])
    tree = clusters.select(*key, "cluster", "parent", "stability")
    if forest._largest(tree, key) <= piece:
        return forest._grouped(tree, key).applyInPandas(
            _eom(key, allow_single_cluster), f"{forest._types(tree, key)}cluster string")
    decided = None
    up = lambda df: df.select(*key, F.col("parent").alias("cluster")).filter("cluster is not null")
    leaves = up(tree).distinct()
    tree = tree.join(leaves.withColumn("inner", F.lit(True)), [*key, "cluster"], "left")
    waiting = write_shared(tree.withColumn("below", F.lit(0.0)), "waiting")
    while not waiting.isEmpty():
        ready = waiting.join(up(waiting).distinct(), [*key, "cluster"], "left_anti")
        keep = ((F.col("stability") >= F.col("below")) | F.col("inner").isNull()) \
            & (F.col("parent").isNotNull() | F.lit(allow_single_cluster))
        ready = write_shared(ready.withColumn("keep", keep).withColumn(
            "best", F.when(keep, F.col("stability")).otherwise(F.col("below"))), "ready")
        part = ready.select(*key, "cluster", "parent", "keep")
        decided = part if decided is None else decided.unionByName(part)
        mass = ready.filter("parent is not null").groupBy(*key, F.col("parent").alias("cluster")).agg(
            F.sum("best").alias("more"))
        waiting = write_shared(
            waiting.join(ready.select(*key, "cluster"), [*key, "cluster"], "left_anti")
            .join(mass, [*key, "cluster"], "left")
            .withColumn("below", F.col("below") + F.coalesce("more", F.lit(0.0))).drop("more"), "waiting")
    decided = write_shared(decided, "decided")
    kept = decided.filter("keep").select(*key, "cluster")
    above = ancestors(decided, kept, key, strict=True)
    return kept.join(above.select(*key, "cluster"), [*key, "cluster"], "left_anti")


def select_leaf(clusters: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Clusters without children (the root only if it is the only one)."""
    key = list(key or [])
    inner = clusters.where(F.col("parent").isNotNull()).select(*key, F.col("parent").alias("cluster"))
    return clusters.select(*key, "cluster").join(inner, [*key, "cluster"], "left_anti")


def ancestors(clusters: DataFrame, selected: DataFrame, key: list[str] | None = None,
              strict: bool = False) -> DataFrame:
    """``(*key, cluster, selected)``: the nearest selected cluster at or (with
    ``strict``) above each cluster that has one. Each round doubles the steps
    climbed: a pointer stops at a selected cluster or at the root."""
    key = list(key or [])
    chosen = selected.select(*key, F.col("cluster").alias("at"), F.lit(True).alias("hit"))
    parent = clusters.select(*key, "cluster", "parent").join(
        selected.select(*key, "cluster", F.lit(True).alias("own")), [*key, "cluster"], "left")
    jump = write_shared(parent.select(
        *key, "cluster", F.when(F.col("own").isNotNull(), F.col("cluster")).otherwise(F.col("parent")).alias("at")), "jump")
    while True:
        known = jump.join(chosen, [*key, "at"], "left").select(*key, "cluster", "at", "hit")
        climbing = known.filter("hit is null and at is not null")
        if climbing.isEmpty():
            break
        second = jump.select(*key, F.col("cluster").alias("at"), F.col("at").alias("to"))
        jump = write_shared(known.join(second, [*key, "at"], "left").select(
            *key, "cluster", F.when(F.col("hit").isNotNull(), F.col("at")).otherwise(F.col("to")).alias("at")), "jump")
    nearest = jump.filter("at is not null").select(*key, "cluster", F.col("at").alias("selected"))
    if not strict:
        return nearest
    over = nearest.withColumnRenamed("cluster", "parent")
    return clusters.filter("parent is not null").select(*key, "cluster", "parent").join(
        over, [*key, "parent"]).select(*key, "cluster", "selected")


def cluster_labels(clusters: DataFrame, members: DataFrame, selected: DataFrame, nodes: DataFrame,
                   key: list[str] | None = None) -> DataFrame:
    """``(id, cluster)``: each point's selected cluster — the nearest one at or
    above the cluster that it fell out of — else −1; labels numbered 0.. by size
    (desc) then smallest member. The numbering window holds a row per cluster."""
    key = list(key or [])
    m = members.select(*key, "node", "cluster").join(ancestors(clusters, selected, key), [*key, "cluster"]) \
        .select(*key, "node", "selected")
    lab = m.groupBy(*key, "selected").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("mn"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("size"), "mn")) - 1
    lab = lab.select(*key, "selected", number.alias("label"))
    return nodes.select(*key, "node").join(m.join(lab, [*key, "selected"]).select(*key, "node", "label"),
                                           [*key, "node"], "left").select(
        *key, F.col("node").alias("id"), F.coalesce("label", F.lit(NOISE)).alias("cluster"))


def cluster_graph(knn: DataFrame, nodes: DataFrame, min_cluster_size, min_samples, selection: str = "eom",
                  allow_single_cluster: bool = False, key: list[str] | None = None,
                  mst: DataFrame | None = None) -> dict[str, DataFrame]:
    """E1–E8 from a neighbour graph ``(*key, src, rank, dst, distance)``, over its
    spanning forest or a given ``mst``."""
    if mst is None:
        mr = mutual_reachability(knn, core_distance(knn, min_samples, key), key)
        mst = minimum_spanning_forest(mr, key)
    clusters, members = condensed_tree(mst, nodes, min_cluster_size, key)
    sel = select_eom(clusters, allow_single_cluster, key) if selection == "eom" else select_leaf(clusters, key)
    labels = write_shared(cluster_labels(clusters, members, sel, nodes, key), "labels")
    return {"labels": labels, "mst": mst, "clusters": clusters, "members": members, "knn": knn}


def neighbour_graph(df: DataFrame, k: int, id_col: str, vec_col: str, metric: str, graph: str = "exact") -> DataFrame:
    """kNN edges by exact blocked search or (``graph='lsh'``) hyperplane buckets."""
    find = {"exact": knn_exact, "lsh": knn_lsh}[graph]
    return write_shared(find(df, k, id_col, vec_col, metric), "knn")


def density_cluster(df: DataFrame, min_cluster_size: int = 15, min_samples: int = 1,
                    selection: str = "eom", allow_single_cluster: bool = False,
                    id_col: str = "doc_id", vec_col: str = "embedding", metric: str = "euclidean",
                    k_graph: int = 15, graph: str = "exact", span: str = "graph") -> dict[str, DataFrame]:
    """E1–E8 composed; returns labels (id, cluster), mst, clusters, members, knn.
    The graph has the ``k_graph`` nearest neighbours, at least ``min_samples``.
    ``span``: ``graph`` for the forest of the neighbour graph, ``all`` for the one
    tree over all pairs (needs exact neighbours)."""
    if k_graph < min_samples:
        raise ValueError("k_graph must be at least min_samples")
    if span == "all" and graph != "exact":
        raise ValueError("the tree over all pairs needs exact neighbours")
    knn = neighbour_graph(df, k_graph, id_col, vec_col, metric, graph)
    nodes = df.select(F.col(id_col).cast("long").alias("node")).distinct()
    mst = None
    if span == "all":
        from agora.operators.span import spanning_tree
        mst = spanning_tree(df, knn, core_distance(knn, min_samples), id_col, vec_col, metric)
    return cluster_graph(knn, nodes, min_cluster_size, min_samples, selection, allow_single_cluster, mst=mst)


# --------------------------------------------------------- E9 – E14 ------

def cluster_sizes(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """``(cluster, size)``, noise included."""
    return labels.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))


def n_clusters(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    return labels.agg(F.countDistinct(F.when(F.col(cluster_col) != NOISE, F.col(cluster_col))).alias("n_clusters"))


def noise_ratio(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """E10."""
    return labels.agg(F.avg((F.col(cluster_col) == NOISE).cast("double")).alias("noise_ratio"))


def relative_validity(mst: DataFrame, labels: DataFrame, id_col: str = "id",
                      cluster_col: str = "cluster", key: list[str] | None = None) -> DataFrame:
    """DBCV restricted to MST edges. Per cluster C: DSC = max internal
    edge, DSPC = min edge to another cluster (2·max edge when none, or
    2·min noise-link when there is one cluster), V = (DSPC−DSC)/max;
    validity = Σ size(C)/N · V with N counting noise."""
    key = list(key or [])
    a = labels.select(*key, F.col(id_col).alias("src"), F.col(cluster_col).alias("ca"))
    b = labels.select(*key, F.col(id_col).alias("dst"), F.col(cluster_col).alias("cb"))
    e = mst.join(a, [*key, "src"]).join(b, [*key, "dst"])
    both = e.select(*key, F.col("ca").alias("c"), F.col("cb").alias("o"), "weight") \
        .unionByName(e.select(*key, F.col("cb").alias("c"), F.col("ca").alias("o"), "weight"))
    per = both.where(F.col("c") != NOISE).groupBy(*key, "c").agg(
        F.max(F.when(F.col("o") == F.col("c"), F.col("weight"))).alias("dsc"),
        F.min(F.when((F.col("o") != F.col("c")) & (F.col("o") != NOISE), F.col("weight"))).alias("dspc"),
        F.min(F.when(F.col("o") == NOISE, F.col("weight"))).alias("noise_link"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("size"))
    sizes = count(labels.where(F.col(cluster_col) != NOISE).groupBy(*key, F.col(cluster_col).alias("c")))
    one = F.lit("").alias("_one")  # joins whole-table figures where there is no key
    whole = labels.groupBy(*key, one).agg(
        F.count(F.lit(1)).cast("double").alias("n_all"),
        F.countDistinct(F.when(F.col(cluster_col) != NOISE, F.col(cluster_col))).alias("k"))
    longest = mst.groupBy(*key, one).agg(F.max("weight").alias("max_edge"))
    j = sizes.withColumn("_one", F.lit("")).join(per, [*key, "c"], "left")
    whole = whole.join(longest, [*key, "_one"], "left")
    dsc = F.coalesce(F.col("dsc"), F.lit(0.0))
    dspc = F.coalesce(F.col("dspc"),
                      F.when((F.col("k") == 1) & F.col("noise_link").isNotNull(), 2.0 * F.col("noise_link"))
                      .otherwise(2.0 * F.col("max_edge")))
    v = F.when(F.greatest(dspc, dsc) > 0, (dspc - dsc) / F.greatest(dspc, dsc)).otherwise(F.lit(0.0))
    scored = whole.join(j, [*key, "_one"], "left").groupBy(*key, "_one").agg(
        F.coalesce(F.sum(F.col("size") / F.col("n_all") * v), F.lit(0.0)).alias("validity"))
    return scored.drop("_one")


def search_score(validity, noise, alpha: float = 0.1):
    """−validity + α·noise_ratio (lower is better)."""
    return -validity + F.lit(alpha) * noise


def candidate_table(spark, space: dict, max_evals: int, seed: int = 0) -> DataFrame:
    """E13 candidates: parameter ``p`` of trial t = low + step ·
    floor(u · n_steps) with u from md5(seed:t:p) — seeded, reproducible."""
    df = spark.range(max_evals).withColumnRenamed("id", "trial")
    for name, (lo, hi, step) in space.items():
        n_steps = int((hi - lo) // step) + 1
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"),
                                                  F.lit(name))), 1, 8), 16, 10).cast("double") / float(16 ** 8)
        df = df.withColumn(name, (F.lit(lo) + F.floor(u * n_steps) * step).cast("int"))
    return df


def sweep_with_labels(df: DataFrame, space: dict, max_evals: int, alpha: float = SWEEP_ALPHA, seed: int = 0,
                      **settings) -> tuple[DataFrame, DataFrame]:
    """E13 with each trial's labels ``(trial, id, cluster)``: see
    :func:`agora.operators.tuning.adaptive_search`."""
    from agora.operators.tuning import adaptive_search
    return adaptive_search(df, space, max_evals, alpha, seed, **settings)


def param_sweep(df: DataFrame, space: dict, max_evals: int = 100, alpha: float = SWEEP_ALPHA, seed: int = 0,
                **settings) -> DataFrame:
    """``(trial, params…, validity, noise_ratio, score)`` of adaptively
    chosen trials; lower scores are better."""
    return sweep_with_labels(df, space, max_evals, alpha, seed, **settings)[0]


def fit_best(df: DataFrame, space: dict, max_evals: int = 100, alpha: float = SWEEP_ALPHA, seed: int = 0,
             **settings) -> tuple[DataFrame, DataFrame]:
    """The best trial's row, and the labels ``(id, cluster)`` of a clustering
    with its parameters (each trial's labels are kept, so nothing is fitted twice)."""
    trials, labels = sweep_with_labels(df, space, max_evals, alpha, seed, **settings)
    best = best_trial(trials)
    return best, labels.join(F.broadcast(best.select("trial")), "trial").drop("trial")


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the lowest score (ties by trial id)."""
    return trials.orderBy("score", "trial").limit(1)
