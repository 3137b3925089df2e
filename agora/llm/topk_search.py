"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are split into ``SLICES`` lists of partial scores; a total is the
sum over the lists. Queries meet rows block by block, and every phase is one
distributed pass:

1. gather: each block takes the k best entries of every list and scores those
   exactly; a query's k-th best gathered total, tau, is a lower bound of its
   k-th best total overall;
2. collect: with the safe cutoff tau / SLICES sent along with its query, each
   block collects all entries that reach the cutoff in some list. An entry
   below it in every list has a total below tau and can't be among the best;
3. resolve: the totals of collected entries are completed exactly, and those of
   at least tau are ranked.

No step holds more than one block of queries and one of rows, and each block
sends on at most k entries per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agora.session import write_shared

SLICES = 4
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
_AT_ONCE = 1 << 22  # partial scores of one list held at once


def usable(vector: Column) -> Column:
    """Not null, and every component neither null nor NaN nor infinite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    flat = a.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(a), -1) if len(a) else flat.reshape(0, 0)
    # products of whole numbers are exact in doubles up to 2^53
    return m


def _lists(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """Partial scores of each list of dimensions, queries x rows."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, q.shape[1]) < 2**52
    q, r = (q.astype(float), r.astype(float)) if exact else (q, r)
    parts = np.array_split(np.arange(q.shape[1]), min(SLICES, max(1, q.shape[1])))
    return [q[:, p] @ r[:, p].T for p in parts]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties to smaller ids."""
    if len(score) > 8 * k:
        cut = np.partition(score, len(score) - k)[-k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _runner(k: int, collect: bool):
    """The work of a block: phase 1, or (``collect``) phases 2 and 3."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            q, r = _matrix(left["vector"]), _matrix(right["vector"])
            keys, own = left["query_key"].to_numpy(), left["query_id"].to_numpy()
            ids = right["vec_id"].to_numpy()
            tau = left["cutoff"].to_pylist() if collect else None
            step = max(1, _AT_ONCE // len(ids))
            for lo in range(0, len(keys), step):
                lists = _lists(q[lo: lo + step], r)
                for i in range(len(lists[0])):
                    other = ids != own[lo + i]
                    if collect and tau[lo + i] is not None:
                        reach = lists[0][i] * len(lists) >= tau[lo + i]
                        for s in lists[1:]:
                            reach |= s[i] * len(lists) >= tau[lo + i]
                        some = np.flatnonzero(reach & other)
                    elif collect:  # fewer than k rows were there to gather
                        some = np.flatnonzero(other)
                    else:
                        there = np.flatnonzero(other)
                        some = np.unique(np.concatenate(
                            [there[_best(s[i][there], ids[there], k)] for s in lists])) if len(there) else there
                    total = sum(s[i][some] for s in lists)
                    if collect and tau[lo + i] is not None:
                        some, total = some[total >= tau[lo + i]], total[total >= tau[lo + i]]
                    top = _best(total, ids[some], k) if len(some) else np.empty(0, np.int64)
                    out[0].append(np.full(len(top), keys[lo + i]))
                    out[1].append(np.full(len(top), own[lo + i]))
                    out[2].append(ids[some[top]])
                    out[3].append(total[top].astype(np.int64))
        names = ["query_key", "query_id", "vec_id", "score"]
        return pa.table({n: np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64)
                         for n, c in zip(names, out)})
    return run


def search(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` rows of highest
    inner product (all, if there are fewer), ties to the smaller ``vec_id``.

    ``queries``: ``query_id`` and ``vector`` (array of long); ``rows``: ``vec_id``
    and ``vector``. A row with the query's own id is no candidate, nor is one of
    another dimension. Rows or queries with a null id or a null vector take no
    part. Equal (id, vector) queries are answered once; rows with equal ids and
    vectors each count. Empty tables give an empty table.
    """
    kinds = F.size("vector").alias("dim")
    q = queries.filter("query_id is not null and vector is not null").select(
        F.col("query_id").cast("long").alias("query_id"), "vector", kinds).dropDuplicates(["query_id", "vector"])
    q = write_shared(q.withColumn("query_key", F.xxhash64("query_id", "vector")), "queries")
    r = write_shared(rows.filter("vec_id is not null and vector is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "vector", kinds), "rows")
    query_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    row_blocks = max(1, -(-r.count() // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_rows = r.withColumn("row_block", F.pmod(F.xxhash64("vec_id", "vector", F.lit(1)), F.lit(row_blocks)).cast("int")) \
        .withColumn("query_block", every(query_blocks))
    dealt = lambda t: t.withColumn("query_block", F.pmod(F.col("query_key"), F.lit(query_blocks)).cast("int")) \
        .withColumn("row_block", every(row_blocks))
    keys = ["dim", "query_block", "row_block"]
    kind = "query_key bigint, query_id bigint, vec_id bigint, score bigint"

    gathered = dealt(q).groupBy(*keys).cogroup(dealt_rows.groupBy(*keys)).applyInArrow(_runner(k, False), kind)
    by_score = F.row_number().over(W.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))
    cutoffs = write_shared(gathered.withColumn("rank", by_score).filter(F.col("rank") <= k)
                           .groupBy("query_key").agg(F.count("*").alias("n"), F.min("score").alias("cutoff"))
                           .filter(F.col("n") == k).drop("n"), "cutoffs")
    cut = q.join(cutoffs, "query_key", "left")
    found = dealt(cut).groupBy(*keys).cogroup(dealt_rows.groupBy(*keys)).applyInArrow(_runner(k, True), kind)
    return (found.withColumn("rank", by_score).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
