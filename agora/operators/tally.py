"""The most frequent n-grams of groups, exactly, where most n-grams are rare.

Most n-grams of a corpus occur once or twice, so a count of them all shuffles about
as much as the text. Here the first pass only adds up hashed n-grams in a table of
fixed size per group. A place of the table holds at least the count of any n-gram on
it, so n-grams on places below a floor occur less often than the floor. The second
pass counts those on the other places, by their words. A group of which ``k`` n-grams
reach the floor is settled; the others are counted in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.operators import terms as terms_ops
from agora.session import write_shared

#: Places of all groups' tables together (16 MB a task), and those that travel in a row.
PLACES, _BLOCK = 1 << 21, 1 << 15
#: Groups that can have a table; more are counted in full.
MOST_GROUPS = 256


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class _Grams:
    """The n-grams of a batch of token lists: rows, first tokens and hashes by length."""

    def __init__(self, lists: pa.Array, min_n: int, max_n: int):
        self.row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        self.words, self.min_n, self.max_n = words.dictionary, min_n, max_n
        self.token = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
        self.hash = own[self.token] if len(own) else np.zeros(0, np.uint64)

    def __iter__(self):
        """``(n, first tokens, hashes)``, n ascending."""
        at, h = np.arange(len(self.token)), self.hash
        for n in range(1, self.max_n + 1):
            if n > 1:  # those that have a next word in their row
                go = np.flatnonzero(at + n - 1 < len(self.token))
                go = go[self.row[at[go]] == self.row[at[go] + n - 1]]
                at, h = at[go], h[go]
                h = _mixed(h) + self.hash[at + n - 1]
            if n >= self.min_n:
                yield n, at, _mixed(h)

    def names(self, n: int, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Codes of the n-grams that begin at ``at``, and the n-grams by code."""
        k = max(1, len(self.words))
        code, name = self.token[at], self.words
        for j in range(1, n):
            both, code = np.unique(code * k + self.token[at + j], return_inverse=True)
            name = pc.binary_join_element_wise(name.take(pa.array(both // k)), self.words.take(pa.array(both % k)), " ")
        return code, name


def _parts(batches, group_col: str, min_n: int, max_n: int):
    """``(groups, group of each row, n-grams)`` of slices of ``(group, terms)``."""
    for whole in batches:
        for lo in range(0, whole.num_rows, terms_ops._ROWS):
            b = whole.slice(lo, terms_ops._ROWS)
            of = b.column(group_col).dictionary_encode()
            yield of.dictionary, of.indices.to_numpy(zero_copy_only=False).astype(np.int64), \
                _Grams(b.column("terms").fill_null([]), min_n, max_n)


def table(tokens: DataFrame, group_col: str, min_n: int, max_n: int, places: int) -> DataFrame:
    """``(group, place, n)``: occurrences of a group's n-grams on each of ``places``
    (a power of two) that has any. A task sends on its sums."""
    kind = tokens.schema[group_col].dataType.simpleString()
    width = min(places, _BLOCK)

    def add(batches):
        sums: dict[object, np.ndarray] = {}
        type_ = None
        for groups, of, grams in _parts(batches, group_col, min_n, max_n):
            type_ = groups.type
            for n, at, h in grams:
                to = of[grams.row[at]] * places + (h & np.uint64(places - 1)).astype(np.int64)
                order = np.bincount(to, minlength=len(groups) * places).reshape(-1, places)
                for g, name in enumerate(groups.to_pylist()):
                    if name in sums:
                        sums[name] += order[g]
                    else:
                        sums[name] = order[g].astype(np.int64)
        for name, n in sums.items():
            for i in range(places // width):
                part = n[i * width: (i + 1) * width]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name], type_), pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                                     names=[group_col, "block", "sums"])

    def total(t: pa.Table) -> pa.Table:
        n = np.zeros(width, np.int64)
        for chunk in t.column("sums").chunks:
            for s in chunk:
                n += np.frombuffer(s.as_buffer(), np.int64)
        at = np.flatnonzero(n)
        group = t.column(group_col).combine_chunks().take(pa.array(np.zeros(len(at), np.int64)))
        return pa.table([group, pa.array(at + width * t.column("block")[0].as_py()), pa.array(n[at])], names=[group_col, "place", "n"])

    sums = tokens.mapInArrow(add, f"`{group_col}` {kind}, block int, sums binary")
    return sums.groupBy(group_col, "block").applyInArrow(total, f"`{group_col}` {kind}, place bigint, n bigint")


def counted(tokens: DataFrame, group_col: str, min_n: int, max_n: int, places: int | None = None,
            wanted: dict[object, np.ndarray] | None = None) -> DataFrame:
    """``(group, term, n, df)``: occurrences and documents of n-grams: of all, or of
    those on a group's ``wanted`` places."""
    kind = tokens.schema[group_col].dataType.simpleString()
    sent = None if wanted is None else {g: np.packbits(w) for g, w in wanted.items()}

    def count(batches):
        open_ = None if sent is None else {g: np.unpackbits(w, count=places).astype(bool) for g, w in sent.items()}
        for groups, of, grams in _parts(batches, group_col, min_n, max_n):
            if open_ is not None and len(groups):
                none = np.zeros(places, bool)
                keep = np.concatenate([open_.get(g, none) for g in groups.to_pylist()])
            for n, at, h in grams:
                if open_ is not None:
                    at = at[keep[of[grams.row[at]] * places + (h & np.uint64(places - 1)).astype(np.int64)]]
                if not len(at):
                    continue
                code, name = grams.names(n, at)
                row, code, times = terms_ops._counted(grams.row[at], code, len(name))
                both, back = np.unique(of[row] * len(name) + code, return_inverse=True)
                total = np.bincount(back, weights=times).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [groups.take(pa.array(both // len(name))), name.take(pa.array(both % len(name))), pa.array(total),
                     pa.array(np.bincount(back).astype(np.int64))], names=[group_col, "term", "n", "df"])

    rows = tokens.mapInArrow(count, f"`{group_col}` {kind}, term string, n bigint, df bigint")
    return rows.groupBy(group_col, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def frequent(tokens: DataFrame, group_col: str, k: int, min_n: int = 1, max_n: int = 1, places: int = PLACES) -> DataFrame:
    """``(group, term, n, df)`` of at least each group's ``k`` most frequent n-grams (all,
    if there are fewer; ties at the last place included), of token lists ``(group,
    terms)``. Both figures are exact. Null groups take no part."""
    tokens = tokens.filter(F.col(group_col).isNotNull()).select(group_col, "terms")
    names = tokens.select(group_col).distinct().limit(MOST_GROUPS + 1).count()
    if names > MOST_GROUPS:
        return counted(tokens, group_col, min_n, max_n)
    places = max(2, places >> max(0, names - 1).bit_length())
    sums = write_shared(table(tokens, group_col, min_n, max_n, places), "table")
    # a floor that some more places than terms are asked for reach; all places, if there are fewer
    want = 2 * k + 16
    place = F.row_number().over(Window.partitionBy(group_col).orderBy(F.desc("n")))
    floors = sums.select(group_col, "n", place.alias("rank")).filter(F.col("rank") <= want).groupBy(group_col).agg(
        F.when(F.max("rank") < want, 1).otherwise(F.min("n")).alias("floor"))
    floors = write_shared(floors, "floors")
    # at most the places of all groups
    open_ = sums.join(F.broadcast(floors), group_col).filter("n >= floor").select(group_col, "place").toArrow()
    wanted: dict[object, np.ndarray] = {}
    group = open_.column(group_col).combine_chunks().dictionary_encode()
    at = open_.column("place").to_numpy()
    for g, name in enumerate(group.dictionary.to_pylist()):
        wanted[name] = np.zeros(places, bool)
        wanted[name][at[group.indices.to_numpy(zero_copy_only=False) == g]] = True
    found = write_shared(counted(tokens, group_col, min_n, max_n, places, wanted), "found")
    reached = found.join(F.broadcast(floors), group_col).groupBy(group_col, "floor").agg(
        F.count_if(F.col("n") >= F.col("floor")).alias("reached"))
    flat = write_shared(reached.filter((F.col("floor") > 1) & (F.col("reached") < k)).select(group_col), "flat")
    rest = counted(tokens.join(F.broadcast(flat), group_col, "left_semi"), group_col, min_n, max_n)
    return found.join(F.broadcast(flat), group_col, "left_anti").unionByName(rest)
