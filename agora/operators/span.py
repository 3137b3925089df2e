"""Minimum spanning tree of all mutual-reachability distances.

Borůvka over the vectors themselves: each round finds every component's lightest
edge to another one, whether or not a neighbour list has it, so the result is one
tree of n - 1 edges. Neighbour lists only save work. They give each component an
upper bound, and a point is searched for only if it can undercut that: its edges
weigh at least its core distance, and those to points outside its list at least the
list's largest distance. What is left is compared with all points block by block;
a task holds two blocks and sends on one edge per component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import forest
from agora.operators.density import mutual_reachability
from agora.session import write_shared

#: Weights are compared after rounding, so that an edge weighs the same from both ends.
DIGITS = 9


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _lightest(metric: str):
    """A block: each component's lightest edge from its points on the left to
    points of other components on the right."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            x, y = _matrix(left["v"]), _matrix(right["v"])
            if metric == "cosine":
                unit = lambda m: np.divide(m, n := np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=n > 0)
                d = 1.0 - unit(x) @ unit(y).T
            else:
                sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T
                d = np.sqrt(np.maximum(sq, 0.0))
            comp, other = left["comp"].to_numpy(), right["comp"].to_numpy()
            w = np.round(np.maximum(d, np.maximum(left["core"].to_numpy()[:, None], right["core"].to_numpy()[None, :])), DIGITS)
            w[comp[:, None] == other[None, :]] = np.inf
            ids, ends = left["id"].to_numpy(), right["id"].to_numpy()
            best = w.min(axis=1)
            keep = np.flatnonzero(np.isfinite(best))
            # of equally light edges the one with the smaller ends
            lows, highs = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
            for at, i in enumerate(keep.tolist()):
                same = ends[w[i] == best[i]]
                low, high = np.minimum(ids[i], same), np.maximum(ids[i], same)
                j = np.lexsort((high, low))[0]
                lows[at], highs[at] = low[j], high[j]
            order = np.lexsort((highs, lows, best[keep], comp[keep]))
            keep, lows, highs = keep[order], lows[order], highs[order]
            first = np.ones(len(keep), bool)
            first[1:] = comp[keep][1:] != comp[keep][:-1]
            out = [[comp[keep][first]], [lows[first]], [highs[first]], [best[keep][first]]]
        c, s, t, w = (np.concatenate(o) if o else np.empty(0) for o in out)
        return pa.table({"comp": c.astype(np.int64), "src": s.astype(np.int64), "dst": t.astype(np.int64), "weight": w.astype(float)})
    return run


def _search(live: DataFrame, points: DataFrame, metric: str, block_rows: int) -> DataFrame:
    """Blocks of ``live`` against blocks of all points, as many as the counts say."""
    n_left, n_right = (max(1, -(-t.count() // block_rows)) for t in (live, points))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = live.withColumn("i", deal(n_left)).withColumn("j", every(n_right))
    right = points.withColumn("j", deal(n_right)).withColumn("i", every(n_left))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(
        _lightest(metric), "comp long, src long, dst long, weight double")


def spanning_tree(vectors: DataFrame, knn: DataFrame, core: DataFrame, id_col: str = "doc_id",
                  vec_col: str = "embedding", metric: str = "euclidean", block_rows: int = 4096) -> DataFrame:
    """``(src, dst, weight)`` of the minimum spanning tree over all pairs, weighed
    by max(core_src, core_dst, distance) and rounded to ``DIGITS`` digits; ties by
    ``(src, dst)``. ``knn``: ``(src, rank, dst, distance)`` of exact neighbours, all
    rows with as many as there are; ``core``: ``(id, core)`` of every row. Rows
    without a vector or an id take no part; fewer than two rows have no edges.
    Vectors have one dimension."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    reach = knn.groupBy(F.col("src").alias("id")).agg(F.max("distance").alias("reach"))
    points = write_shared(rows.filter("id is not null and v is not null").join(core.select("id", "core"), "id")
                          .join(reach, "id", "left"), "points")
    known = write_shared(mutual_reachability(knn, core).withColumn("weight", F.round("weight", DIGITS)), "known")
    comps = write_shared(points.select(F.col("id").alias("node"), F.col("id").alias("comp")), "comps")
    picked = None
    while comps.select("comp").distinct().limit(2).count() > 1:
        end = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        # edges that lie inside a component are of no more use
        known = write_shared(known.select("src", "dst", "weight").join(end("src"), "src").join(end("dst"), "dst")
                             .filter("src_comp <> dst_comp"), "known")
        edge = F.struct("weight", "src", "dst")
        sides = known.select(F.col("src_comp").alias("comp"), edge.alias("e")).unionAll(
            known.select(F.col("dst_comp").alias("comp"), edge.alias("e")))
        bound = sides.groupBy("comp").agg(F.min("e").alias("e"))
        placed = write_shared(points.join(comps.withColumnRenamed("node", "id"), "id"), "placed")
        least = F.greatest(F.col("core"), F.coalesce("reach", F.lit(0.0))) - 10.0 ** -DIGITS
        live = write_shared(placed.join(bound, "comp", "left").filter(
            F.col("e").isNull() | (least <= F.col("e.weight"))).select("comp", "id", "v", "core"), "live")
        found = write_shared(_search(live, placed.drop("reach"), metric, block_rows), "found")
        best = write_shared(bound.unionByName(found.select("comp", edge.alias("e"))).groupBy("comp").agg(F.min("e").alias("e"))
                            .select("e.src", "e.dst", "e.weight").distinct(), "picked")
        picked = best if picked is None else picked.unionByName(best)
        known = known.select("src", "dst", "weight").unionByName(found.select("src", "dst", "weight")).distinct()
        ends = best.join(end("src"), "src").join(end("dst"), "dst").select(
            F.col("src_comp").alias("a"), F.col("dst_comp").alias("b"))
        roots = forest.components(ends).select(F.col("node").alias("comp"), "root")
        comps = write_shared(comps.join(roots, "comp", "left").select(
            "node", F.coalesce("root", "comp").alias("comp")), "comps")
    if picked is None:
        return known.select("src", "dst", "weight").limit(0)
    return forest.spanning_forest(picked.distinct())
