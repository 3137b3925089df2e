"""Nearest neighbours.

Exact search is a *blocked* self join: each group of points (all points,
or one LSH bucket) is hashed into a bounded number of blocks; every block
pair of a group meets in one Arrow task that computes the distances tile by
tile and emits only each row's ``k`` best candidates. The final top-k per
point is a window. No step emits all pairs, and no task holds more than two
blocks and a tile. Approximate search starts from hash buckets
and improves the neighbour graph by joining neighbours of neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import vectors as V
from agora.session import write_shared

RANK_DIGITS = 9


def pairwise_distances(vectors: DataFrame, pairs: DataFrame | None = None, id_col: str = "doc_id",
                       vec_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Distances for given candidate pairs ``(src, dst)`` — an equi join
    of the vectors onto both ends; the pair list decides the work. Without a list,
    those of all pairs, ranked: :func:`all_distances`."""
    if pairs is None:
        return all_distances(vectors, id_col, vec_col, metric)
    a = vectors.select(F.col(id_col).alias("src"), F.col(vec_col).alias("_a"))
    b = vectors.select(F.col(id_col).alias("dst"), F.col(vec_col).alias("_b"))
    j = pairs.select("src", "dst").join(a, "src").join(b, "dst")
    d = (F.lit(1.0) - V.cosine("_a", "_b")) if metric == "cosine" else V.euclidean("_a", "_b")
    return j.select("src", "dst", d.alias("distance"))


#: Bytes of distances that a strip of rows holds, its rows at the most, and rows of a batch that it sends on.
_STRIP_BYTES, _STRIP_ROWS, _SENT = 128 << 20, 512, 1 << 16


def all_distances(df: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``(src, rank, dst, distance)`` of all ordered pairs of rows with different
    ids, ranked by distance (ties by dst) among all pairs of ``src``. Rows without an
    id or a vector have no pairs; a vector with a missing component has distances null.

    Points are dealt into strips by their ids. All vectors go to every strip, in order
    of their ids, and are streamed past its points: a strip holds its points' distances
    (``_STRIP_BYTES``; one point's, if that is more), never the vectors, and no pair is shuffled."""
    pts = write_shared(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        "id is not null and v is not null"), "points")
    n = pts.count()
    rows = max(1, min(_STRIP_ROWS, _STRIP_BYTES // (8 * max(1, n))))
    strips = max(1, -(-n // rows))
    tasks = min(strips, 16384)
    own = pts.select(F.pmod(F.xxhash64("id"), F.lit(strips)).cast("int").alias("strip"), F.lit(0).alias("side"), "id", "v")
    every = pts.select(F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.lit(1).alias("side"), "id", "v")
    dealt = own.unionByName(every).repartitionById(tasks, F.pmod("strip", F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("strip", "side", "id").mapInArrow(
        _strips(n, metric), "src long, rank long, dst long, distance double")


def _vectors(column: pa.Array, rows: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (of unit length for cosines; NaN where a component is missing) and squared lengths."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size != 0)
    return x, (x * x).sum(1)


def _between(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``x`` to those of ``y`` (see :func:`_vectors`)."""
    d = x @ y.T
    if metric == "cosine":
        return np.subtract(1.0, d, out=d)
    d *= -2.0
    d += xs[:, None] + ys[None, :]
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


def _strips(n: int, metric: str):
    names = ["src", "rank", "dst", "distance"]

    def ranked(src: np.ndarray, dst: np.ndarray, held: np.ndarray):
        """Arrays of ``names`` for each id of a strip."""
        for a in np.flatnonzero(np.append(True, src[1:] != src[:-1])).tolist():
            b = int(np.searchsorted(src, src[a], "right"))
            other = dst != src[a]
            to, d = np.tile(dst[other], b - a), held[a:b][:, other].ravel()
            key = np.nan_to_num(np.round(d, RANK_DIGITS), nan=1.0 if metric == "cosine" else np.inf)
            order = np.lexsort((to, key)) if b - a > 1 else np.argsort(key, kind="stable")
            yield np.full(len(d), src[a]), np.arange(1, len(d) + 1), to[order], d[order]

    def sent(parts):
        """Batches of about ``_SENT`` rows."""
        held, size = [], 0
        for part in parts:
            for lo in range(0, len(part[0]), _SENT):
                held.append([c[lo: lo + _SENT] for c in part])
                size += len(held[-1][0])
                if size >= _SENT:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def batch(held):
        src, rank, dst, d = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(rank), pa.array(dst), pa.array(d, from_pandas=True)], names=names)

    def run(batches):
        strip, mine, at, dst, held = None, [], 0, np.empty(n, np.int64), None

        def done():
            if held is not None:
                yield from map(batch, sent(ranked(np.concatenate([m[0] for m in mine]), dst[:at], held[:, :at])))

        for b in batches:
            of, side = b.column("strip").to_numpy(), b.column("side").to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if of[lo] != strip:
                    yield from done()
                    strip, mine, at, held = of[lo], [], 0, None
                ids = b.column("id").to_numpy()[lo:hi]
                x, size = _vectors(b.column("v").slice(lo, hi - lo), hi - lo, metric)
                if side[lo] == 0:
                    mine.append((ids, x, size))
                elif mine:  # a strip may have no points of its own
                    if held is None:
                        points, sizes = np.concatenate([m[1] for m in mine]), np.concatenate([m[2] for m in mine])
                        held = np.empty((len(points), n))
                    held[:, at: at + len(ids)] = _between(points, sizes, x, size, metric)
                    dst[at: at + len(ids)] = ids
                    at += len(ids)
        yield from done()
    return run


class _Nearest:
    """The ``k`` nearest so far of each of ``n`` points, ties by id. Distances come in
    order of the other points' ids, so a tie that comes later never displaces an earlier
    one, and only what is strictly nearer than a point's k-th is held. What is held is
    cut down to ``k`` each time it has doubled."""

    def __init__(self, n: int, k: int):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.raw, self.ids = np.full((n, 4 * k), np.inf), np.zeros((n, 4 * k), np.int64)
        self.bound = np.full(n, np.inf)

    def take(self, row: np.ndarray, raw: np.ndarray, ids: np.ndarray) -> None:
        """Distances of the points ``row`` (ascending) to points whose ids come after all before."""
        nearer = raw < self.bound[row]
        if not nearer.all():
            row, raw, ids = row[nearer], raw[nearer], ids[nearer]
        if not len(row):
            return
        new = np.bincount(row, minlength=len(self.count))
        most = int((self.count + new).max())
        if most > self.raw.shape[1]:
            more = ((0, 0), (0, most - self.raw.shape[1]))
            self.raw, self.ids = np.pad(self.raw, more, constant_values=np.inf), np.pad(self.ids, more)
        place = np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(self.count, new)
        self.raw[row, place], self.ids[row, place] = raw, ids
        self.count += new
        if self.count.sum() > 2 * self.k * len(self.count) or most > 4 * self.k:
            self.cut()

    def cut(self) -> None:
        k, most = self.k, int(self.count.max(initial=0))
        rounded = np.round(self.raw[:, :most], RANK_DIGITS)
        order = np.argsort(rounded, axis=1, kind="stable")[:, :k]
        kept = order.shape[1]
        self.raw[:, :kept] = np.take_along_axis(self.raw[:, :most], order, 1)
        self.ids[:, :kept] = np.take_along_axis(self.ids[:, :most], order, 1)
        self.raw[:, kept:most] = np.inf
        self.count = np.minimum(self.count, k)
        if kept == k:  # infinite where a point has fewer
            self.bound = np.take_along_axis(rounded, order[:, -1:], 1)[:, 0] - 0.4 * 10.0 ** -RANK_DIGITS

    def table(self, src: np.ndarray) -> pa.Table:
        self.cut()
        row, col = np.nonzero(np.isfinite(self.raw[:, :self.k]))
        return pa.table([pa.array(src[row], pa.int64()), pa.array(self.ids[row, col], pa.int64()),
                         pa.array(self.raw[row, col], pa.float64())], names=["src", "dst", "distance"])


#: Rows and columns of a tile: the products that a task holds at once (8 MB).
_TILE = 1024, 1024


def _nearest_of(lids: np.ndarray, lx: np.ndarray, rids: np.ndarray, rx: np.ndarray, k: int, metric: str) -> list[pa.Table]:
    """For each left point its ``k`` nearest right ones of other ids; ids ascend. A tile
    is a matrix product, compared with the points' bounds as it is; distances are made
    of what passes. By Euclid it is x . y - y . y / 2, that is (x . x - distance²) / 2."""
    step, wide = _TILE
    if metric != "cosine":
        lx, rx = np.column_stack([lx, np.ones(len(lx))]), np.column_stack([rx, (rx * rx).sum(1) / -2])
    out = []
    products, passed = np.empty(step * wide), np.empty(step * wide, bool)  # used again: new memory costs more than the product
    for a in range(0, len(lids), step):
        ids, x = lids[a: a + step], lx[a: a + step]
        own = (x[:, :-1] ** 2).sum(1)
        near = _Nearest(len(ids), k)
        if metric == "cosine":
            distance = lambda dot, row: 1.0 - dot
            least = lambda far, row: 1.0 - far
        else:  # the least product is below what rounding can hide
            distance = lambda dot, row: np.sqrt(np.maximum(own[row] - 2.0 * dot, 0.0))
            least = lambda far, row: np.where(far < 0, np.inf, (own[row] - far**2) / 2 - 1e-15 * (own[row] + far**2))
        b, w = 0, min(wide, max(256, 4 * k))
        while b < len(rids):
            others = rids[b: b + w]
            shape = len(ids), len(others)
            dot = np.matmul(x, rx[b: b + w].T, out=products[: shape[0] * shape[1]].reshape(shape))
            if others[0] <= ids[-1] and others[-1] >= ids[0]:
                dot[ids[:, None] == others[None, :]] = -np.inf
            far, fresh = near.bound.copy(), np.isinf(near.bound)
            if fresh.any() and shape[1] > k:  # its own k-th, ties included
                first = np.where(np.isnan(dot[fresh]), -np.inf, dot[fresh])
                kth = np.partition(first, shape[1] - k, axis=1)[:, shape[1] - k]
                far[fresh] = distance(kth, np.flatnonzero(fresh)) + 10.0 ** -RANK_DIGITS
            bound = least(far, np.arange(shape[0]))
            at = np.flatnonzero(np.greater(dot, bound[:, None], out=passed[: dot.size].reshape(shape)))
            row, col = np.divmod(at, shape[1])
            near.take(row, distance(dot.ravel()[at], row), others[col])
            b, w = b + w, wide
        out.append(near.table(ids))
    return out


def _block_fn(k: int, metric: str):
    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids, ascending, and their vectors (unit length for cosines)."""
        t = t.sort_by("_id")
        x = t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(t.num_rows, -1)
        if metric == "cosine":
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        return t.column("_id").to_numpy(), x

    def run(t: pa.Table) -> pa.Table:
        of = t.column("_side").to_numpy()
        t = t.select(["_id", "_v"])
        left = side(t.filter(pa.array(of == 0)))
        if not (of == 1).any():
            found = _nearest_of(*left, *left, k, metric)
        else:
            right = side(t.filter(pa.array(of == 1)))
            found = _nearest_of(*left, *right, k, metric) + _nearest_of(*right, *left, k, metric) if len(left[0]) else []
        return pa.concat_tables(found) if found else _Nearest(0, k).table(left[0])
    return run


def _in_lists(find):
    """What a block task finds, a row per point: its neighbours and their distances."""
    def run(t: pa.Table) -> pa.Table:
        found = find(t).combine_chunks()
        src = found.column("src").to_numpy()
        starts = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.empty(0, np.int64)
        ends = pa.array(np.append(starts, len(src)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(found.column(c).chunks) if len(src) else pa.array([], found.schema.field(c).type))
                 for c in ("dst", "distance")]
        return pa.table([pa.array(src[starts], pa.int64()), *lists], names=["src", "dst", "distance"])
    return run


#: Blocks of a group, so that no row meets more tasks as the group grows; blocks of
#: more than ``_BLOCK_BYTES`` of vectors are not made, then there are more of them.
MOST_BLOCKS, _BLOCK_BYTES = 12, 64 << 20


def blocked_topk(points: DataFrame, k: int, group_cols: list[str] | None = None,
                 metric: str = "cosine", block_rows: int = 2048, lists: bool = False) -> DataFrame:
    """Top-``k`` neighbours of every point among the points of its group(s).
    ``points``: (``_id`` long, ``_v`` array, *group_cols). Returns
    ``(src, dst, distance)`` candidates (≤ k per point per block pair), with ``lists``
    a row per point and block pair, of arrays.

    A group has blocks of about ``block_rows`` points, or ``MOST_BLOCKS`` larger ones:
    a point goes to as many tasks as its group has blocks, so what is shuffled grows
    with the points, not with their square. Points without a vector have no neighbours."""
    gcols = list(group_cols or [])
    points = points.filter(F.col("_v").isNotNull())
    if not gcols:
        points = points.withColumn("_g", F.lit(0))
    keys = gcols or ["_g"]
    n, wide = F.count(F.lit(1)), F.max(F.size("_v")) * F.lit(8.0)
    blocks = F.least(F.ceil(n / F.lit(block_rows)), F.greatest(F.lit(MOST_BLOCKS), F.ceil(n * wide / F.lit(_BLOCK_BYTES))))
    sizes = points.groupBy(*keys).agg(F.greatest(F.lit(1), blocks).cast("int").alias("_nb"))
    pts = points.join(sizes if gcols else F.broadcast(sizes), keys).withColumn(
        "_b", F.pmod(F.xxhash64(F.col("_id")), F.col("_nb")).cast("int"))
    met = pts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    both = met.select(*keys, F.least("_b", "_o").alias("_bi"), F.greatest("_b", "_o").alias("_bj"),
                      (F.col("_b") > F.col("_o")).cast("int").alias("_side"), "_id", "_v")
    met = both.groupBy(*keys, "_bi", "_bj")
    if lists:
        return met.applyInArrow(_in_lists(_block_fn(k, metric)), "src long, dst array<long>, distance array<double>")
    return met.applyInArrow(_block_fn(k, metric), "src long, dst long, distance double")


def top_k_edges(cands: DataFrame, k: int) -> DataFrame:
    """Final ``(src, rank, dst, distance)``: k nearest per src, ties by dst."""
    c = cands.repartition("src").dropDuplicates(["src", "dst"])
    w = Window.partitionBy("src").orderBy(F.round("distance", RANK_DIGITS), F.col("dst"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("src", "rank", "dst", "distance")


#: Neighbours of lists that are merged at once in a task.
_MERGED = 1 << 20


def _merge(k: int):
    """Streams lists in order of ``src`` and sends on each one's ``k`` nearest, ties by dst."""
    def best(t: pa.Table) -> pa.RecordBatch:
        dst, distance = (t.column(c).combine_chunks() for c in ("dst", "distance"))
        src = np.repeat(t.column("src").to_numpy(), dst.value_lengths().to_numpy())
        dst, distance = dst.flatten().to_numpy(), distance.flatten().to_numpy()
        rounded = np.round(distance, RANK_DIGITS)

        def first(some: np.ndarray) -> np.ndarray:
            pair = some[np.lexsort((rounded[some], dst[some], src[some]))]
            a, b = src[pair], dst[pair]
            pair = pair[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(pair)]]  # an id may come twice
            order = pair[np.lexsort((dst[pair], rounded[pair], src[pair]))]
            return order[np.arange(len(order)) - np.searchsorted(src[order], src[order]) < k]

        # what is beyond a point's k-th candidate is not sorted
        row = np.cumsum(np.append(False, src[1:] != src[:-1]))[: len(src)]
        count = np.bincount(row)
        most, near = int(count.max(initial=0)), np.arange(len(src))
        if k < most and most * len(count) <= 4 * len(src):
            table = np.full((len(count), most), np.inf)
            table[row, near - np.repeat(np.cumsum(count) - count, count)] = rounded
            near = np.flatnonzero(rounded <= np.partition(table, k - 1, axis=1)[row, k - 1])
        order = first(near)
        if len(near) < len(src) and (np.bincount(row[order], minlength=len(count)) < np.minimum(count, k)).any():
            order = first(np.arange(len(src)))  # ids that come twice took places among the k
        src = src[order]
        rank = np.arange(len(src)) - np.searchsorted(src, src) + 1
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(rank.astype(np.int32)), pa.array(dst[order]),
                                           pa.array(distance[order])], names=["src", "rank", "dst", "distance"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            if not t.num_rows:
                continue
            src = t.column("src").to_numpy()
            sizes = np.cumsum(t.column("dst").combine_chunks().value_lengths().to_numpy())
            cuts = np.flatnonzero(src[1:] != src[:-1]) + 1  # the last point may go on
            a = 0
            while len(cuts) and a < cuts[-1]:
                most = np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _MERGED)
                i = np.searchsorted(cuts, most, "right") - 1
                z = int(cuts[i]) if i >= 0 and cuts[i] > a else int(cuts[np.searchsorted(cuts, a, "right")])
                yield best(t.slice(a, z - a))
                a = z
            held = t.slice(a)
        if held is not None and held.num_rows:
            yield best(held)
    return run


def nearest(points: DataFrame, k: int, group_cols: list[str] | None = None, metric: str = "cosine",
            block_rows: int = 2048) -> DataFrame:
    """``(src, rank, dst, distance)``: :func:`blocked_topk` and then what
    :func:`top_k_edges` does, with a point's candidates of a block in one row."""
    lists = blocked_topk(points, k, group_cols, metric, block_rows, lists=True)
    return lists.repartition("src").sortWithinPartitions("src").mapInArrow(
        _merge(k), "src long, rank int, dst long, distance double")


def knn_exact(df: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "embedding",
              metric: str = "cosine", block_rows: int = 2048) -> DataFrame:
    """Exact k nearest neighbours (self excluded), cosine distance
    ``1 − cos`` or Euclidean."""
    pts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v"))
    return nearest(pts, k, None, metric, block_rows)


def hyperplanes(d: int, n_tables: int, n_bits: int, seed: int = 0) -> list[list[list[float]]]:
    """Fixed Gaussian hyperplanes (a parameter: tables × bits × d)."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n_tables, n_bits, d)).tolist()


#: Points that a bucket should have: the number of bits follows the row count.
BUCKET = 256


def bits_for(n: int, bucket: int = BUCKET) -> int:
    """Bits that leave about ``bucket`` of ``n`` rows in a bucket."""
    return max(0, int(np.floor(np.log2(max(1, n) / bucket)))) if n > bucket else 0


def knn_lsh(df: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "embedding",
            metric: str = "cosine", n_tables: int = 4, n_bits: int | None = None, seed: int = 0,
            block_rows: int = 2048, dim: int | None = None, least_change: float = 0.002,
            bucket: int = BUCKET, width: int | None = None) -> DataFrame:
    """Approximate kNN: hyperplane buckets, then neighbour-graph descent.

    Each point lands in one bucket per table (sign pattern of ``n_bits``
    projections, computed inside the JVM; by default as many as leave about
    ``bucket`` rows in a bucket, whatever the row count). Exact blocked search
    within buckets gives a first graph of ``width`` neighbours each (four times
    ``k``, 20 at least), which :func:`descend` improves until few edges change; the
    ``k`` best are returned."""
    if dim is None:
        first = df.select(F.size(vec_col)).first()
        dim = first[0] if first else 1
    pts = write_shared(df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).filter(
        F.col("_v").isNotNull()), "points")
    if n_bits is None:
        n_bits = bits_for(pts.count(), bucket)
    width = width or max(4 * k, 20)
    if n_bits == 0:
        return nearest(pts, k, None, metric, block_rows)
    planes = hyperplanes(dim, n_tables, n_bits, seed)
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in h]) for h in t]) for t in planes])
    sig = F.transform(tables, lambda t: F.aggregate(
        F.transform(t, lambda h, j: F.when(V.dot(F.col("_v"), h) > 0, F.pow(F.lit(2), j).cast("long"))
                    .otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b))
    dealt = pts.select("_id", "_v", F.posexplode(sig).alias("_table", "_sig"))
    graph = nearest(dealt, width, ["_table", "_sig"], metric, block_rows)
    return descend(pts, graph, width, metric, least_change, seed).filter(F.col("rank") <= k)


#: Neighbours of a point that meet in one row; longer lists are cut into pieces.
MEET = 64


def descend(points: DataFrame, graph: DataFrame, k: int, metric: str = "cosine",
            least_change: float = 0.002, seed: int = 0) -> DataFrame:
    """Neighbour-graph descent: a neighbour of a neighbour is likely a neighbour.

    Each round joins every point's neighbours, in both directions, with each
    other through the point; a pair whose distance is below the farthest one that
    either end has comes into its list. Lists keep their ``k`` best, so distances
    only fall, and rounds go on until at most ``least_change`` of all edges
    change. Points that very many others name (hubs) have their callers dealt into
    pieces of ``MEET``, so no row grows with a hub. Only pairs with an edge that is
    new since the last round are formed.

    ``points``: ``(_id, _v)``; ``graph``: ``(src, rank, dst, distance)``. A vector goes
    to the points whose list it is in, once each, and not to every pair."""
    graph = write_shared(graph.withColumn("new", F.lit(True)), "graph")
    total = graph.count()
    while total:
        both = graph.select(F.col("src").alias("mid"), F.col("dst").alias("end"), "new").union(
            graph.select(F.col("dst").alias("mid"), F.col("src").alias("end"), "new"))
        both = both.groupBy("mid", "end").agg(F.max("new").alias("new"))
        # a hub's callers fall into pieces; a fresh deal in each round brings others together
        seed += 1
        size = both.groupBy("mid").agg(F.ceil(F.count("*") / F.lit(MEET)).alias("pieces"), F.max("new").alias("any"))
        piece = F.pmod(F.xxhash64("end", F.lit(seed)), F.col("pieces"))
        worst = graph.groupBy("src").agg(F.max(F.struct("distance", "dst")).alias("w"), F.count("*").alias("n"))
        bound = worst.select(F.col("src").alias("end"), F.when(F.col("n") >= k, F.col("w.distance")).alias("worst"))
        vectors = points.select(F.col("_id").alias("end"), F.col("_v").alias("v"))
        dealt = (both.join(size, "mid").filter("any").select("mid", piece.alias("piece"), "end", "new")
                 .join(vectors.join(bound, "end", "left"), "end"))
        found = _met(dealt, metric)
        old = graph.select("src", "dst", "distance", F.lit(False).alias("new"))
        # an edge that is there already stays the old one
        merged = old.unionByName(found.withColumn("new", F.lit(True))).groupBy("src", "dst").agg(
            F.min("distance").alias("distance"), F.min("new").alias("new"))
        w = Window.partitionBy("src").orderBy(F.round("distance", RANK_DIGITS), F.col("dst"))
        graph = write_shared(merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "graph")
        n, changed = graph.agg(F.count("*"), F.count(F.when(F.col("new"), 1))).first()
        if changed <= least_change * n:
            break
    return graph.select("src", "rank", "dst", "distance")


def _met(dealt: DataFrame, metric: str) -> DataFrame:
    """``(src, dst, distance)`` of the pairs that meet in one ``(mid, piece)`` of rows
    ``(mid, piece, end, new, worst, v)``, one end or both new, where the distance is
    not above the worst of ``src``'s list. Rows are streamed in order of the pieces."""
    def pairs(t: pa.Table):
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        if metric == "cosine":
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        end, new = t.column("end").to_numpy(), t.column("new").to_numpy()
        worst = t.column("worst").fill_null(np.inf).to_numpy()
        mid, piece = t.column("mid").to_numpy(), t.column("piece").to_numpy()
        cuts = np.flatnonzero((mid[1:] != mid[:-1]) | (piece[1:] != piece[:-1])) + 1
        out = [], [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mid)]):
            if metric == "cosine":
                d = 1.0 - x[a:b] @ x[a:b].T
            else:
                d = np.sqrt(((x[a:b, None] - x[None, a:b]) ** 2).sum(axis=2))
            i, j = np.nonzero((d <= worst[a:b, None]) & (new[a:b, None] | new[None, a:b]) & (end[a:b, None] != end[None, a:b]))
            out[0].append(end[a + i]), out[1].append(end[a + j]), out[2].append(d[i, j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["src", "dst", "distance"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            mid, piece = t.column("mid").to_numpy(), t.column("piece").to_numpy()
            last = int(np.flatnonzero((mid != mid[-1]) | (piece != piece[-1])).max(initial=-1)) + 1
            held = t.slice(last)
            if last:
                yield pairs(t.slice(0, last))
        if held is not None and held.num_rows:
            yield pairs(held)

    rows = dealt.select("mid", "piece", "end", "new", "worst", "v")
    return rows.repartition("mid", "piece").sortWithinPartitions("mid", "piece").mapInArrow(
        run, "src long, dst long, distance double")


def _distances(points: DataFrame, pairs: DataFrame, metric: str) -> DataFrame:
    """``(src, dst, distance)`` of pairs, a batch of rows at a time."""
    side = lambda c: points.select(F.col("_id").alias(c), F.col("_v").alias(f"_{c}"))
    rows = pairs.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "_src", "_dst")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("_src", "_dst"))
            if metric == "cosine":
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                dot = np.einsum("ij,ij->i", x, y)
                d = 1.0 - np.divide(dot, size, out=np.zeros(len(dot)), where=size > 0)
            else:
                d = np.sqrt(((x - y) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(d)], names=["src", "dst", "distance"])

    return rows.mapInArrow(run, "src long, dst long, distance double")


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact (src, dst) edges the approximate result found."""
    hit = exact.join(approx.select("src", "dst").withColumn("_hit", F.lit(1)), ["src", "dst"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
