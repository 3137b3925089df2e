"""Hard negatives by a secondary sort.

Anchors meet rows block by block. A first pass finds each anchor's best rows of
its own label, its positives; a positive of score p opens the window of scores
from ``low`` to 100 percent of p. A second pass keeps, of each block, what can be
among the first negatives of some window: the best rows of another label inside
it. Positives and negatives then go into one shuffle by anchor, sorted within
partitions by (anchor, descending score, positives first, id). A streaming
iterator walks that order: a positive opens its window, a negative goes to every
open window that it is inside of and that isn't full, and all an anchor ever
holds is its open windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agora.session import write_shared

ANCHOR_BLOCK, ROW_BLOCK = 4096, 4096
_AT_ONCE = 1 << 21  # scores held at once
_PAIR = "anchor_id bigint, anchor_key bigint, id bigint, score bigint"


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks()
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1)


def _product(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where they are exact there,
    else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, a.shape[1])
    if most < 2**52:
        return (a.astype(float) @ r.astype(float).T).astype(np.int64)
    return a @ r.T


def _first(score: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``some`` the ``k`` of highest score, ties to the smaller
    place (places ascend by id)."""
    if len(some) > 8 * k:
        s = score[some]
        some = some[s >= np.partition(s, len(s) - k)[-k]]
    return some[np.argsort(-score[some], kind="stable")[:k]]


def _pairs(pick) -> callable:
    """The work of a block: for each anchor the places that ``pick`` takes from
    its scores, whether rows have its label, and its positives' scores."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("id", "ascending"), ("key", "ascending")])
            names = np.unique(np.concatenate([left["label"].to_numpy(), right["label"].to_numpy()]))
            of_a, of_r = (np.searchsorted(names, t["label"].to_numpy()) for t in (left, right))
            ids, keys = right["id"].to_numpy(), right["key"].to_numpy()
            own, own_key = left["id"].to_numpy(), left["key"].to_numpy()
            a, r = _matrix(left["vector"]), _matrix(right["vector"])
            windows = left["positives"].to_pylist() if "positives" in left.column_names else [None] * len(own)
            step = max(1, _AT_ONCE // len(ids))
            for lo in range(0, len(own), step):
                scores = _product(a[lo: lo + step], r)
                for i, s in enumerate(scores, lo):
                    other = (ids != own[i]) | (keys != own_key[i])
                    some = pick(s, (of_r == of_a[i]) & other, of_r != of_a[i], windows[i])
                    out[0].append(np.full(len(some), own[i]))
                    out[1].append(np.full(len(some), own_key[i]))
                    out[2].append(ids[some])
                    out[3].append(s[some])
        names = ["anchor_id", "anchor_key", "id", "score"]
        return pa.table({n: np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64)
                         for n, c in zip(names, out)})
    return run


def _met(anchors: DataFrame, rows: DataFrame, pick, blocks: tuple[int, int]) -> DataFrame:
    """Every anchor block with every row block of the same dimension."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, seed: F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.lit(n)).cast("int")
    left = anchors.withColumn("anchor_block", block(blocks[0], 1)).withColumn("row_block", every(blocks[1]))
    right = rows.withColumn("row_block", block(blocks[1], 2)).withColumn("anchor_block", every(blocks[0]))
    by = ["dim", "anchor_block", "row_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_pairs(pick), _PAIR)


def _stream(k: int, low: int):
    """Walk the sorted pairs; one anchor's open windows are all that is held."""
    def run(batches):
        current, windows, held = None, [], None

        def closed():
            return [(*current, w[0], rank, n, w[1], s) for w in windows for rank, (n, s) in enumerate(w[2], 1)]

        def batch(found):
            columns = list(zip(*found)) if found else [()] * 7
            kinds = [pa.int64()] * 7
            names = ["anchor_id", "anchor_key", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for b in batches:
            found: list[tuple] = []
            columns = [b.column(c).to_pylist() for c in ("anchor_id", "anchor_key", "score", "kind", "id")]
            for anchor, key, score, kind, id_ in zip(*columns):
                if (anchor, key) != current:
                    if current is not None:
                        found += closed()
                    current, windows, held = (anchor, key), [], []
                if kind == 0:
                    w = (id_, score, [])
                    windows.append(w)
                    held.append(w)
                    continue
                # windows open by falling score, so those that are full or passed leave
                held = [w for w in held if len(w[2]) < k and 100 * score >= low * w[1]]
                for w in held:
                    w[2].append((id_, score))
            if found:
                yield batch(found)
        if current is not None:
            yield batch(closed())
    return run


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each anchor and each of its first ``positives`` rows
    of the same label, the first ``negatives`` rows of another label with ``low *
    positive_score <= 100 * negative_score <= 100 * positive_score``.

    ``rows``: ``id``, ``label`` (any type), ``vector`` (array of long), ``anchor``
    (boolean); other columns are ignored. Scores are integer inner products,
    which must fit into 64 bits; higher ones come first, ties by smaller id.
    Rows with a null id, label or vector, or a null component, take no part, nor
    do rows meet rows of another dimension. Exact repeats of a row (id, label,
    vector) count once; rows that only share an id are different rows, and an
    anchor is no partner of itself alone. An anchor without positives, or a
    positive without negatives in its window, has no rows in the result. Empty
    tables give an empty table. Nothing is cut off: a label or a vector that
    very many rows share lies in as many blocks as it needs, and each block
    sends on at most ``positives * negatives`` rows of an anchor.
    """
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    r = rows.filter(usable).select(
        F.col("id").cast("long").alias("id"), F.xxhash64("label").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"),
        F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"), F.xxhash64("id", "label", "vector").alias("key"),
        F.size("vector").alias("dim"))
    r = write_shared(r.groupBy("id", "key", "label", "dim").agg(
        F.first("vector").alias("vector"), F.max("anchor").alias("anchor")), "rows")
    n, n_anchors = r.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    blocks = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n // ROW_BLOCK))
    anchors, r = write_shared(r.filter("anchor").drop("anchor"), "anchors"), r.drop("anchor")

    best = _met(anchors, r, lambda s, same, other, _: _first(s, np.flatnonzero(same), positives), blocks)
    by_score = W.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "id")
    best = write_shared(best.withColumn("rank", F.row_number().over(by_score)).filter(
        F.col("rank") <= positives).drop("rank"), "positives")
    listed = best.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(
        F.collect_list("score").alias("positives"))

    def inside(s, same, other, windows):
        places = np.flatnonzero(other)
        v = s[places]
        parts = [_first(s, places[(100 * v >= low * p) & (v <= p)], negatives) for p in set(windows)]
        return np.unique(np.concatenate(parts)) if parts else places[:0]

    near = _met(write_shared(anchors.join(listed, ["id", "key"]), "windows"), r, inside, blocks)
    pairs = best.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))
    order = ["anchor_id", "anchor_key", F.desc("score"), "kind", "id"]
    return (pairs.repartition("anchor_id", "anchor_key").sortWithinPartitions(*order)
            .mapInArrow(_stream(negatives, low), "anchor_id bigint, anchor_key bigint, positive_id bigint, rank bigint, "
                        "negative_id bigint, positive_score bigint, negative_score bigint")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))
