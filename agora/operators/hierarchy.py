"""Topic hierarchy (G11–G15): cosine distances between topic c-TF-IDF rows,
Ward agglomeration, cuts, topic reduction and label helpers.

Ward is reducible, so every round may merge all reciprocal nearest neighbours at
once; merges are then numbered by distance. The table of cluster pairs is kept
and only pairs of merged clusters are computed anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.constants import NOISE
from agora.session import write_shared


def topic_distance(scores: DataFrame) -> DataFrame:
    """``(a, b, distance)`` for every ordered topic pair, distance =
    1 − cosine of the topics' c-TF-IDF rows (1.0 when they share no term,
    0 on the diagonal). Shared-term products come from an equi join on the
    term (pairs per term ≤ topics², topics being the small dimension)."""
    s = scores.select("topic", "term", F.col("score").cast("double").alias("w"))
    nrm = s.groupBy("topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    dots = (s.select(F.col("topic").alias("a"), "term", F.col("w").alias("wa"))
            .join(s.select(F.col("topic").alias("b"), "term", F.col("w").alias("wb")), "term")
            .groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot")))
    ids = nrm.select("topic")
    n_t = ids.select(F.max("topic") + 1).scalar()
    pairs = ids.select(F.col("topic").alias("a"), F.explode(F.sequence(F.lit(0), n_t - 1)).alias("b")) \
        .join(ids.select(F.col("topic").alias("b")), "b", "left_semi")
    j = (pairs.join(dots, ["a", "b"], "left")
         .join(nrm.select(F.col("topic").alias("a"), F.col("n").alias("na")), "a")
         .join(nrm.select(F.col("topic").alias("b"), F.col("n").alias("nb")), "b"))
    cos = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))) \
        .otherwise(F.lit(0.0))
    dist = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - cos))
    return j.select("a", "b", dist.alias("distance"))


#: Cluster pairs that one task may finish: some ten megabytes.
WARD_PIECE = 1_000_000


def ward_hierarchy(dist: DataFrame, piece: int = WARD_PIECE) -> DataFrame:
    """``(step, parent, left, right, distance, size, topics)``; leaves
    keep their topic ids, merge ``step`` (1-based, ordered by distance)
    creates node ``n_leaves + step − 1``.

    Rounds merge all reciprocal nearest neighbours of the table of cluster pairs
    and update the pairs of merged clusters only (Lance–Williams). When at most
    ``piece`` pairs are left, one task finishes them; there is no limit to the
    rounds, and a round without a merge is an error."""
    # ids are places among the leaves in ascending order
    leaves = dist.select(F.col("a").cast("long").alias("leaf")).distinct()
    leaves = write_shared(leaves.withColumn("c", (F.row_number().over(Window.orderBy("leaf")) - 1).cast("long")), "leaves")
    n = leaves.count()
    end = lambda c: leaves.select(F.col("leaf").alias(c), F.col("c").alias(f"{c}c"))
    pairs = write_shared(dist.filter("a < b").join(end("a"), "a").join(end("b"), "b").select(
        F.col("ac").alias("a"), F.col("bc").alias("b"), (F.col("distance") * F.col("distance")).alias("d2"),
        F.lit(1.0).alias("na"), F.lit(1.0).alias("nb")), "pairs")
    done, next_id, rnd = None, n, 0
    while (left := pairs.count()) > piece:
        both = pairs.select("a", "b", "d2", "na", "nb").union(pairs.select("b", "a", "d2", "nb", "na"))
        near = both.groupBy("a").agg(F.min(F.struct(F.round("d2", 12).alias("r"), "b", "d2", "na", "nb")).alias("m")) \
            .select("a", "m.b", "m.d2", "m.na", "m.nb")
        back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merged = near.join(back, ["a", "b"]).filter("a < b")
        new = F.lit(next_id) + F.row_number().over(Window.orderBy("d2", "a")) - 1  # a row per merge
        merged = write_shared(merged.withColumn("new", new.cast("long")).withColumn("round", F.lit(rnd)), "merged")
        k = merged.count()
        if not k:
            raise RuntimeError(f"no pair of nearest neighbours among {left} pairs")
        next_id, rnd = next_id + k, rnd + 1
        done = merged if done is None else done.unionByName(merged)
        into = merged.select(F.col("a").alias("x"), "new", F.col("d2").alias("own")).union(merged.select("b", "new", "d2"))
        side = lambda c: into.select(F.col("x").alias(c), F.col("new").alias(f"new_{c}"), F.col("own").alias(f"own_{c}"))
        kept = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
            F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"), "d2", "na", "nb",
            F.coalesce("own_a", F.lit(0.0)).alias("oa"), F.coalesce("own_b", F.lit(0.0)).alias("ob"),
            F.col("new_a").isNotNull().alias("ta"), F.col("new_b").isNotNull().alias("tb")).filter("a <> b")
        flip = F.col("a") > F.col("b")
        pick = lambda x, y: F.when(flip, F.col(x)).otherwise(F.col(y))
        kept = kept.select(pick("b", "a").alias("a"), pick("a", "b").alias("b"), "d2", pick("nb", "na").alias("na"),
                           pick("na", "nb").alias("nb"), pick("ob", "oa").alias("oa"), pick("oa", "ob").alias("ob"),
                           pick("ta", "tb").alias("two_b"))
        # Ward from the mean of squared leaf distances: each old pair's share of it,
        # less what lies within the merged clusters
        pairs = write_shared(_ward_update(kept), "pairs")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return _ward_rest(pdf, next_id, rnd)

    kind = "a long, b long, d2 double, na double, nb double, new long, round int"
    rest = pairs.groupBy(F.lit("all")).applyInPandas(finish, kind)
    merges = write_shared(rest if done is None else done.select(*rest.columns).unionByName(rest), "merges")

    ordered = merges.withColumn("step", F.row_number().over(Window.orderBy("d2", "round", "new")))  # a row per merge
    names = leaves.select(F.col("c").alias("id"), F.col("leaf").alias("name")).union(
        ordered.select("new", (F.lit(n) + F.col("step") - 1).cast("long")))
    name = lambda c, as_: names.select(F.col("id").alias(c), F.col("name").alias(as_))
    out = (ordered.join(name("a", "left"), "a").join(name("b", "right"), "b").join(name("new", "parent"), "new")
           .select("step", "parent", "left", "right", F.sqrt("d2").alias("distance"),
                   (F.col("na") + F.col("nb")).cast("long").alias("size"), "new"))
    under = _leaves_under(merges, leaves)
    return out.join(under, "new").drop("new")


def _ward_update(kept: DataFrame) -> DataFrame:
    """Pairs of clusters after merges, from the pairs of their parts: ``a, b, d2,
    na, nb`` per part pair, with ``oa``/``ob`` the squared distance at which the
    part's own cluster was merged (0: it was not) and ``two_b``: b was merged.

    With D2(A, B) = 2 nA nB / (nA + nB) times the squared distance of centres, the
    centres' distance follows from the parts' by weighting with sizes and taking
    off each side's own spread, n1 n2 / (n1 + n2)^2 times its parts' distance."""
    gap = F.col("d2") * (F.col("na") + F.col("nb")) / (2 * F.col("na") * F.col("nb"))
    part = kept.withColumn("gap", gap)
    g = part.groupBy("a", "b").agg(
        F.sum(F.col("na") * F.col("nb") * F.col("gap")).alias("s"), F.sum(F.col("na") * F.col("nb")).alias("w"),
        F.max("oa").alias("oa"), F.max("ob").alias("ob"), F.max("two_b").alias("two_b"),
        F.collect_list(F.struct("na", "nb")).alias("parts"))  # four at the most
    # the total sizes: w = nA * nB, and sums over one side's parts
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["na"])
    a_size = F.when(F.col("two_b"), total / 2).otherwise(total)
    g = g.withColumn("na", a_size).withColumn("nb", F.col("w") / F.col("na"))
    # own spread: D2 = 2 n1 n2 / (n1 + n2) gap, so n1 n2 gap / n^2 = D2 / (2 n)
    centre = F.col("s") / F.col("w") - F.col("oa") / (2 * F.col("na")) - F.col("ob") / (2 * F.col("nb"))
    d2 = 2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * F.greatest(centre, F.lit(0.0))
    return g.select("a", "b", d2.alias("d2"), "na", "nb")


def _ward_rest(pdf: pd.DataFrame, next_id: int, rnd: int) -> pd.DataFrame:
    """Merge the clusters of a small table of pairs, nearest first."""
    ids = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
    m = len(ids)
    a, b = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
    d = np.full((m, m), np.inf)
    d[a, b] = d[b, a] = pdf["d2"]
    size = np.ones(m)
    size[a], size[b] = pdf["na"], pdf["nb"]
    name, rows = ids.astype(np.int64).copy(), []
    live = np.ones(m, bool)
    for k in range(m - 1):
        at = np.flatnonzero(live)
        sub = np.round(d[np.ix_(at, at)], 12)
        i, j = divmod(int(sub.argmin()), len(at))
        i, j = sorted((at[i], at[j]))
        own = d[i, j]
        left, right = sorted((int(name[i]), int(name[j])))
        sizes = (size[i], size[j]) if left == name[i] else (size[j], size[i])
        rows.append((left, right, own, *sizes, next_id + k, rnd + k))
        d[i] = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * own) / (size + size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        size[i] += size[j]
        name[i], live[j] = next_id + k, False
    return pd.DataFrame(rows, columns=["a", "b", "d2", "na", "nb", "new", "round"])


def _leaves_under(merges: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(new, topics)`` — sorted leaf names under each merge node. Pointers to
    the merge above double their reach each round: ``reach`` holds (node, node
    above it at any distance) pairs, which is what is returned, per leaf."""
    up = write_shared(merges.select(F.col("a").alias("x"), F.col("new").alias("to")).union(merges.select("b", "new")), "up")
    reach = leaves.select(F.col("c").alias("leaf"), F.col("c").alias("at"))
    jump, grown = up, reach
    while True:
        further = write_shared(grown.join(jump, F.col("at") == F.col("x")).select("leaf", F.col("to").alias("at")), "further")
        if further.isEmpty():
            break
        grown = write_shared(grown.unionByName(further), "reach")
        second = jump.select(F.col("x").alias("to"), F.col("to").alias("over"))
        jump = write_shared(jump.join(second, "to").select("x", F.col("over").alias("to")), "jump")
    name = leaves.select(F.col("c").alias("leaf"), F.col("leaf").alias("name"))
    return (grown.join(merges.select(F.col("new").alias("at")), "at").join(name, "leaf")
            .groupBy(F.col("at").alias("new")).agg(F.array_sort(F.collect_list(F.col("name").cast("int"))).alias("topics")))


def hierarchy_cut(merges: DataFrame, n_leaves: int, n_clusters: int) -> DataFrame:
    """``(topic, cluster)`` after applying the first n_leaves −
    n_clusters merges: each leaf's latest applied merge node, else itself."""
    k = max(n_leaves - n_clusters, 0)
    applied = merges.where(F.col("step") <= k).select("step", "parent", F.explode("topics").alias("topic"))
    last = applied.groupBy("topic").agg(F.max_by("parent", "step").alias("cluster"))
    leaves = merges.select(F.explode("topics").alias("topic")).distinct()
    return leaves.join(last, "topic", "left").select("topic", F.coalesce("cluster", "topic").alias("cluster"))


def topic_hierarchy_levels(merges: DataFrame) -> DataFrame:
    """``(level, topic, cluster)``: each leaf's node after the first ``level``
    merges, for every level from none to all. A leaf's node changes only at its
    own merges, so each holds from one of them to the next."""
    own = merges.select(F.explode("topics").alias("topic"), "step", "parent")
    last = merges.select(F.max("step").alias("last"))
    leaves = own.select("topic").distinct().select(
        "topic", F.lit(0).alias("step"), F.col("topic").alias("parent"))
    runs = leaves.unionByName(own.select("topic", F.col("step").cast("int").alias("step"), "parent"))
    until = F.lead("step").over(Window.partitionBy("topic").orderBy("step"))
    runs = runs.withColumn("until", until).join(F.broadcast(last))
    upto = F.coalesce(F.col("until") - 1, F.col("last")).cast("int")
    return runs.select(F.explode(F.sequence(F.col("step"), upto)).alias("level"), "topic",
                       F.col("parent").alias("cluster"))


def document_hierarchy(merges: DataFrame, doc_topics: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, level, topic)``: the topic of each document at each level of
    the hierarchy (level 0: its own; noise stays noise)."""
    levels = topic_hierarchy_levels(merges)
    named = levels.select("level", "topic", "cluster")
    every = levels.select("level").distinct().select("level", F.lit(NOISE).alias("topic"), F.lit(NOISE).alias("cluster"))
    return doc_topics.select(id_col, "topic").join(named.union(every), "topic").select(
        id_col, "level", F.col("cluster").alias("topic"))


def reduce_topics(merges: DataFrame, doc_topics: DataFrame, n_leaves: int, nr_topics: int,
                  id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Merge to ``nr_topics`` topics, renumber 0.. by size (desc, ties
    by old cluster id), and map documents. Returns (topic_mapping
    (topic → new_topic), new doc_topics)."""
    cut = hierarchy_cut(merges, n_leaves, nr_topics)
    d = doc_topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).join(cut, "topic", "left").select(
        "topic", "n", F.when(F.col("topic") == NOISE, F.lit(NOISE)).otherwise(F.col("cluster")).alias("cluster"))
    size = d.groupBy("cluster").agg(F.sum("n").alias("n"))
    number = F.row_number().over(Window.orderBy(F.desc("n"), "cluster")) - 1  # one row per cluster
    new = size.filter(F.col("cluster") != NOISE).select("cluster", number.alias("new_topic"))
    mapping = d.join(new, "cluster", "left").select(
        F.col("topic").alias("old_topic"), F.coalesce("new_topic", F.lit(NOISE)).alias("new_topic"))
    docs = doc_topics.select(id_col, F.col("topic").alias("old_topic")).join(mapping, "old_topic").select(
        id_col, F.col("new_topic").alias("topic"))
    return mapping, docs


def combine_labels(label, higher, topic_id):
    """``"{label} ({higher})"``; default label ``Topic {id}``."""
    base = F.coalesce(label, F.concat(F.lit("Topic "), topic_id.cast("string")))
    return F.when(higher.isNull(), base).otherwise(F.concat(base, F.lit(" ("), higher, F.lit(")")))
