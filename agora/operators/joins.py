"""Join helpers and the reference's join shapes.

Broadcast is only ever applied to a side whose size has a proven bound:
a stated table (queries, keywords, groups) or an operator output
with a cap (e.g. the max_features vocabulary). Everything else is left to
the planner, where AQE turns a join into a broadcast at runtime when the
measured side is small and splits skewed partitions when it is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.functions.vectors import norm


def _unit(c: str):
    n = norm(F.col(c))
    return F.when(n > 0, F.transform(F.col(c), lambda v: v.cast("double") / n))


def attach_by_key(left: DataFrame, right: DataFrame, key: str = "doc_id",
                  cols: list[str] | None = None) -> DataFrame:
    """Left equi-join on an explicit key (replaces row-index alignment);
    unmatched rows keep NULL."""
    r = right.select(key, *(cols or [c for c in right.columns if c != key]))
    return left.join(r, key, "left")


def subset_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Keep rows whose key is in ``ids`` (a semi join, never positions)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


#: Rows of a stated table that go to the left rows at once.
RIGHT_BLOCK, LEFT_BLOCK = 4096, 1 << 16
#: Pairs whose products are held at once in a task.
_AT_ONCE = 1 << 20


def similarity_join(left: DataFrame, right: DataFrame, left_vec: str, right_vec: str,
                    threshold: float | None = None, out_col: str = "similarity") -> DataFrame:
    """Every left row against every row of a stated right table (keywords,
    category queries, topic vectors), cosine similarity, optional theta
    predicate ``similarity > threshold``. Vectors come out at length 1; a missing
    or zero vector, or one of another dimension, is similar by 0.

    A right table of up to ``RIGHT_BLOCK`` rows goes to the left rows where they
    are: one matrix product per batch, and no shuffle. A larger one is dealt into
    blocks of that size, the left rows into parts of ``LEFT_BLOCK``, and every part
    meets every block in a task of its own: tasks follow the data.

    With a threshold of 0 or more, right rows of a block are grouped around pivots;
    the triangle inequality of angles tells, before any product, which groups a
    left row can't reach."""
    clash = [c for c in right.columns if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    unit_l = left.withColumn(left_vec, _unit(left_vec))
    unit_r = right.withColumn(right_vec, _unit(right_vec))
    first = unit_r.limit(RIGHT_BLOCK + 1).toArrow()
    schema = T.StructType([*unit_l.schema.fields, *unit_r.schema.fields, T.StructField(out_col, T.DoubleType())])
    if first.num_rows <= RIGHT_BLOCK:
        def run(batches):
            groups = _grouped(first, right_vec)
            for b in batches:
                yield from _paired(b, first, groups, left_vec, threshold, out_col)

        return unit_l.mapInArrow(run, schema)

    blocks = -(-unit_r.count() // RIGHT_BLOCK)
    parts = max(1, -(-unit_l.count() // LEFT_BLOCK))
    deal = lambda n, cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["__part", "__block"]
    dealt_l = unit_l.withColumn("__part", deal(parts, [c for c in left.columns if c != left_vec] or [left_vec])).withColumn("__block", every(blocks))
    dealt_r = unit_r.withColumn("__block", deal(blocks, [c for c in right.columns if c != right_vec] or [right_vec])).withColumn("__part", every(parts))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        mine = b.drop_columns(keys)
        groups = _grouped(mine, right_vec)
        found = [x for batch in a.drop_columns(keys).to_batches(max_chunksize=4096)
                 for x in _paired(batch, mine, groups, left_vec, threshold, out_col)]
        return pa.Table.from_batches(found) if found else pa.table(
            {f.name: pa.nulls(0, t) for f, t in zip(schema.fields, [*a.drop_columns(keys).schema.types, *b.drop_columns(keys).schema.types, pa.float64()])})

    return dealt_l.groupBy(*keys).cogroup(dealt_r.groupBy(*keys)).applyInArrow(meet, schema)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector (0: none), and the values end to end."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, a.flatten().to_numpy(zero_copy_only=False)


class Pivots:
    """Unit vectors in groups around about as many pivots as a group has vectors, and
    for each group the least and largest angle of its vectors to every pivot."""

    #: Fewer vectors than this are one group without a pivot.
    LEAST = 32
    #: Angles are compared with this slack, far above the error of an arc cosine.
    SLACK = 1e-6

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        whole = np.flatnonzero(np.isfinite(vectors).all(axis=1))  # others are above no threshold
        vectors, n = vectors[whole], len(whole)
        if n < self.LEAST:
            self.pivots, self.groups = vectors[:0], [whole]
            self.low = self.high = np.zeros((1, 0))
            return
        # farthest first: the next pivot is the vector least like all before
        at, nearest = [0], vectors @ vectors[0]
        while len(at) < np.ceil(np.sqrt(n)) and nearest.min() < 1 - self.SLACK:
            at.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, vectors @ vectors[at[-1]])
        self.pivots = vectors[at]
        angles = self._angles(vectors)
        of = angles.argmin(axis=1)
        members = [np.flatnonzero(of == p) for p in np.unique(of)]
        self.groups = [whole[g] for g in members]
        self.low = np.stack([angles[g].min(axis=0) for g in members])
        self.high = np.stack([angles[g].max(axis=0) for g in members])

    def _angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))

    def above(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Places in ``x`` and in the vectors, and likeness, of all pairs above the
        threshold (0 or more), and how many products that took."""
        reach = np.arccos(min(1.0, threshold)) + self.SLACK
        angles = self._angles(x)
        products = len(x) * len(self.pivots)
        i, j, likeness = [], [], []
        for g, low, high in zip(self.groups, self.low, self.high):
            near = np.flatnonzero(((angles <= high + reach) & (angles >= low - reach)).all(axis=1))
            products += len(near) * len(g)
            score = x[near] @ self.vectors[g].T
            a, b = np.nonzero(score > threshold)
            i.append(near[a]), j.append(g[b]), likeness.append(score[a, b])
        return np.concatenate(i), np.concatenate(j), np.concatenate(likeness), products


def _grouped(right: pa.Table, right_vec: str) -> dict[int, tuple[np.ndarray, Pivots]]:
    """For each dimension the rows of it and their vectors around pivots."""
    size, flat = _rows(right.column(right_vec))
    at = np.cumsum(size) - size
    places = {int(d): np.flatnonzero(size == d) for d in np.unique(size[size > 0])}
    return {d: (p, Pivots(flat[at[p, None] + np.arange(d)])) for d, p in places.items()}


def _paired(batch: pa.RecordBatch, right: pa.Table, groups: dict[int, tuple[np.ndarray, Pivots]], left_vec: str,
            threshold: float | None, out_col: str) -> Iterator[pa.RecordBatch]:
    """All pairs of the rows that pass the threshold, a bounded number at a time."""
    m = right.num_rows
    if not m:
        return
    step = max(1, _AT_ONCE // m)
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        size_l, flat_l = _rows(part.column(left_vec))
        at_l = np.cumsum(size_l) - size_l
        vectors = lambda mine, d: flat_l[at_l[mine, None] + np.arange(d)]
        alike = [(np.flatnonzero(size_l == d), d) for d in np.unique(size_l[size_l > 0]).tolist() if d in groups]
        if threshold is not None and threshold >= 0:  # pairs without a product are similar by 0 and not wanted
            found = [np.empty((3, 0))]
            for mine, d in alike:
                other, around = groups[d]
                a, b, score, _ = around.above(vectors(mine, d), threshold)
                found.append(np.stack([mine[a], other[b], score]))
            i, j, scores = np.hstack(found)
            order = np.lexsort((j, i))
            i, j, scores = i[order].astype(np.int64), j[order].astype(np.int64), scores[order]
        else:
            likeness = np.zeros((part.num_rows, m))
            for mine, d in alike:
                other, around = groups[d]
                likeness[np.ix_(mine, other)] = vectors(mine, d) @ around.vectors.T
            i, j = np.nonzero(likeness > threshold) if threshold is not None else np.indices(likeness.shape).reshape(2, -1)
            scores = likeness[i, j]
        for a in range(0, len(i), _AT_ONCE // 16):
            ii, jj = i[a: a + _AT_ONCE // 16], j[a: a + _AT_ONCE // 16]
            l, r = part.take(pa.array(ii)), right.take(pa.array(jj)).combine_chunks()  # noqa: E741
            columns = [*l.columns, *(c.combine_chunks() for c in r.columns), pa.array(scores[a: a + _AT_ONCE // 16])]
            yield pa.RecordBatch.from_arrays(columns, names=[*l.schema.names, *r.schema.names, out_col])
