"""Exact n-gram Jaccard join of whole texts, and the components of its links.

Texts with the same shingle set share a digest and are handled once. Two sets can
only reach the threshold if they share a shingle in their prefixes (the first
``n - ceil(t n) + 1`` shingles in one global order); shingles that many texts
share stand last in that order, so common passages hardly ever come into a
prefix. The texts of one prefix shingle meet in size-banded tiles: a band spans a
factor 1/t of set sizes, so links lie within a band or between neighbours.

In a tile, hashed bitmap signatures are compared first: every bit that only one
of two bitmaps has stands for a shingle that only that set has, so bit counts
bound the overlap from above. Pairs whose bound reaches the threshold are decided
by intersecting the exact sorted arrays.

Only components are asked for. So the first round links each member of a tile to
one leader, the next ones to the member of another component that bitmaps say is
nearest, and the last one compares all that is still in different components, block by block; pairs within a component need no comparison, and a
large group of near copies costs comparisons in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agora.llm.common import mix64, list_array, shingles, signed, slices, texts_of, wide_rows
from agora.session import write_shared

SHINGLE, PERCENT = 5, 80
#: Bits of a signature: the power of two at or above this many times the set's
#: size, so that about two fifths of them are set, whatever the size.
BITS_EACH, LEAST_BITS = 2, 64
#: Shingles that get a place at the end of the order: a bounded list. Which ones
#: they are changes what is compared, never what is found.
COMMON = 65_536
_COMMON_IN_TASK, _WINDOW = 4, 1 << 20
TILE = 2048
#: Rounds in which each member meets the nearest one of another component, before
#: all that is left is compared.
TURNS = 2


def _sets(part: pa.RecordBatch, text: str) -> list[np.ndarray]:
    hashes, rows = texts_of(part.column(text)).word_hashes()
    return shingles(hashes, rows, SHINGLE)


def _digest(s: np.ndarray) -> int:
    """64 bits of a set; never of an empty one."""
    h = np.array([np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) ^ np.uint64(len(s))], np.uint64)
    return int(signed(mix64(h))[0])


def _bitmap(s: np.ndarray) -> np.ndarray:
    width = 1 << max(LEAST_BITS, BITS_EACH * len(s) - 1).bit_length()
    bits = np.zeros(width, np.uint8)
    bits[s & np.uint64(width - 1)] = 1
    return np.packbits(bits).view(np.int64)


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps brought to ``words`` 64-bit words: a bit's place is a hash
    modulo the width, so halves lie one over the other."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


def signatures(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """One row per document (``id, jk, n, d, bitmap``: id, join key of the row,
    set size, digest, bitmap), and the common shingles, commonest last.

    Shingles in several texts of a run of rows are counted within the task;
    only those counts are summed up."""
    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        held_size = 0

        def common():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= _COMMON_IN_TASK
            return v[often], c[often]

        def batch(ids, jks, n, d, bitmaps, shingle, count):
            return pa.RecordBatch.from_arrays(
                [ids, jks, pa.array(n, pa.int64()), pa.array(d, pa.int64()),
                 list_array(bitmaps, pa.int64()), pa.array(shingle, pa.int64()), pa.array(count, pa.int64())],
                names=["id", "jk", "n", "d", "bitmap", "shingle", "count"])

        def counts(v, c):
            k = len(v)
            return batch(pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), [None] * k, [None] * k,
                         [np.empty(0, np.int64)] * k, signed(v), c)

        for part in slices(batches, "text"):
            sets = _sets(part, "text")
            digests = [_digest(s) if len(s) else None for s in sets]
            for s, d in zip(sets, digests):
                if d is not None and d not in seen:
                    seen.add(d)
                    held.append(s)
                    held_size += len(s)
            m = part.num_rows
            yield batch(part.column("id"), part.column("jk"), [len(s) for s in sets], digests,
                        [_bitmap(s) if len(s) else np.empty(0, np.int64) for s in sets], [None] * m, [None] * m)
            if held_size > _WINDOW:
                yield counts(*common())
                held, held_size = [], 0
                if len(seen) > 1 << 18:
                    seen.clear()
        if held:
            yield counts(*common())

    out = write_shared(_keyed(documents, key, text).mapInArrow(
        run, "id bigint, jk string, n bigint, d bigint, bitmap array<bigint>, shingle bigint, count bigint"), "signatures")
    top = (out.filter("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("c"))
           .orderBy(F.desc("c"), "shingle").limit(COMMON).toArrow())
    common = top.column("shingle").combine_chunks().to_numpy().view(np.uint64)[::-1].copy()
    return out.filter("n is not null").drop("shingle", "count"), common


def _keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``text`` and a join key that is never null: the id, or else a hash
    of the text."""
    return documents.select(
        F.col(key).cast("long").alias("id"), F.col(text).alias("text"),
        F.coalesce(F.col(key).cast("string"), F.concat(F.lit("t"), F.xxhash64(F.col(text)).cast("string"))).alias("jk"))


def _prefixes(documents: DataFrame, key: str, text: str, common: np.ndarray) -> DataFrame:
    """``(shingle, d, n)``: the prefix of each distinct set of a task."""
    by_value = np.argsort(common, kind="stable")
    values = common[by_value]

    def run(batches):
        seen: set[int] = set()
        for part in slices(batches, "text"):
            keys, ds, ns = [], [], []
            for s in _sets(part, "text"):
                if not len(s):
                    continue
                d = _digest(s)
                if d in seen:
                    continue
                seen.add(d)
                p = len(s) - -(-PERCENT * len(s) // 100) + 1
                if len(values):
                    at = np.searchsorted(values, s)
                    at[at == len(values)] = 0
                    late = values[at] == s
                    first = s[~late]
                    if len(first) < p:
                        first = np.concatenate([first, s[late][np.argsort(by_value[at[late]], kind="stable")]])
                else:
                    first = s
                keys.append(first[:p])
                ds.append(np.full(p, d, np.int64))
                ns.append(np.full(p, len(s), np.int64))
            if len(seen) > 1 << 18:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ns))],
                    names=["shingle", "d", "n"])

    return documents.select(F.col(text).alias("text")).mapInArrow(run, "shingle bigint, d bigint, n bigint")


def _tiles(prefixes: DataFrame) -> DataFrame:
    """``(shingle, tile, band, d, n, lead)``: members of every size-banded tile
    with at least two different sets, and the tile's leader."""
    own = W.partitionBy("shingle")
    shared = prefixes.withColumn("lo", F.min("d").over(own)).withColumn("hi", F.max("d").over(own)) \
        .filter("lo <> hi").select("shingle", "d", "n")
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / PERCENT) + 1e-9).cast("int")
    tile = W.partitionBy("shingle", "tile")
    return (shared.distinct().withColumn("band", band)
            .withColumn("tile", F.explode(F.array(F.col("band") - 1, F.col("band"))))
            .withColumn("lead", F.min("d").over(tile)).withColumn("hi", F.max("d").over(tile))
            .withColumn("low", F.min("band").over(tile))
            .filter("lead <> hi and low = tile").drop("hi", "low"))


def _reaches(inner: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return 100 * inner >= PERCENT * (na + nb - inner)


def _most_common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most shingles that two sets can share, by their bitmaps (rows)."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def _bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether bit counts leave room for enough overlap."""
    return _reaches(_most_common(a, b, na, nb), na, nb)


class _Maps:
    """A column of bitmaps of different widths."""

    def __init__(self, column):
        a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.flat = a.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.words = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.cumsum(self.words) - self.words

    def rows(self, some: np.ndarray, words: int) -> np.ndarray:
        """The bitmaps of some rows, all brought to ``words``."""
        out = np.empty((len(some), words), np.uint64)
        for w in np.unique(self.words[some]).tolist():
            mine = self.words[some] == w
            out[mine] = _folded(self.flat[self.at[some[mine], None] + np.arange(w)], words)
        return out


def _bounded(a: _Maps, b: _Maps, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each row, whether the pair's bit counts leave room for a link."""
    out = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    words = np.minimum(a.words, b.words)
    for w in np.unique(words[out]).tolist():
        at = np.flatnonzero(out & (words == w))
        for lo in range(0, len(at), max(1, (1 << 20) // w)):
            some = at[lo: lo + max(1, (1 << 20) // w)]
            out[some] = _bound(a.rows(some, w), b.rows(some, w), na[some], nb[some])
    return out


def _near(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of digests that sizes and bitmaps leave possible."""
    def bound(batches):
        for x in batches:
            if x.num_rows:
                ok = _bounded(_Maps(x.column("map_a")), _Maps(x.column("map_b")),
                              x.column("n_a").to_numpy(), x.column("n_b").to_numpy())
                yield x.select(["a", "b"]).filter(pa.array(ok))

    side = lambda c: sig.select(F.col("d").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"map_{c}"))
    with wide_rows(pairs.sparkSession, 1024):
        return write_shared(pairs.join(side("a"), "a").join(side("b"), "b")
                            .select("a", "b", "n_a", "n_b", "map_a", "map_b")
                            .mapInArrow(bound, "a bigint, b bigint"), "near")


def _sets_of(wanted: DataFrame, sig: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(d, shingles)``: exact sorted arrays of the wanted digests, made from the
    text of one document each."""
    def arrays(batches):
        for part in slices(batches, "text"):
            sets = _sets(part, "text")
            want = part.column("d").to_pylist()
            # an id given to several texts brings them all; one has the digest
            mine = [i for i, s in enumerate(sets) if len(s) and _digest(s) == want[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([want[i] for i in mine], pa.int64()),
                 pa.array([sets[i].tobytes() for i in mine], pa.binary())], names=["d", "shingles"])

    rows = wanted.select("d").distinct().join(sig.select("d", "jk"), "d")
    with wide_rows(documents.sparkSession):
        return write_shared(_keyed(documents, key, text).select("jk", "text").join(rows, "jk").select("d", "text")
                            .mapInArrow(arrays, "d bigint, shingles binary"), "sets").dropDuplicates(["d"])


def _links(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose exact arrays reach the threshold."""
    def exact(batches):
        for x in batches:
            ok = []
            for sa, sb in zip(x.column("set_a"), x.column("set_b")):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (sa, sb))
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                ok.append(bool(_reaches(np.count_nonzero(large[at] == small), len(a), len(b))))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_set = lambda c: sets.select(F.col("d").alias(c), F.col("shingles").alias(f"set_{c}"))
    with wide_rows(near.sparkSession):
        return write_shared(near.join(with_set("a"), "a").join(with_set("b"), "b").select("a", "b", "set_a", "set_b")
                            .mapInArrow(exact, "a bigint, b bigint"), "links")


def _rooted(tiles: DataFrame, roots: DataFrame) -> DataFrame:
    """Tiles with each member's component, if it has more than one of them."""
    tile = W.partitionBy("shingle", "tile")
    return (tiles.join(roots.withColumnRenamed("node", "d"), "d", "left")
            .withColumn("root", F.coalesce("root", "d"))
            .withColumn("lo", F.min("root").over(tile)).withColumn("hi", F.max("root").over(tile))
            .withColumn("members", F.count("*").over(tile))
            # two members have met as leader and member
            .filter("lo <> hi and members > 2").drop("lo", "hi"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    return write_shared(components(links.unionByName(
        roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")


def _open(tiles: DataFrame, roots: DataFrame, sig: DataFrame, every: bool) -> DataFrame:
    """Pairs ``(a, b)`` of a tile that are in different components and that sizes
    and bitmaps leave possible: all of them, or for each member of a block the
    one that bitmaps say is nearest. A tile is cut into blocks of about ``TILE``
    members, and one task compares two blocks."""
    rooted = _rooted(tiles, roots).withColumn("blocks", F.ceil(F.col("members") / F.lit(TILE)))
    block = F.pmod(F.xxhash64("d"), F.col("blocks"))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (rooted.withColumn("block", block).withColumn("other", meets)
             .select("shingle", "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "band", "d", "root", "n")
             .join(sig.select("d", "bitmap"), "d")
             .repartition("shingle", "tile", "i", "j").sortWithinPartitions("shingle", "tile", "i", "j"))

    def run(batches):
        held: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            names = ["shingle", "tile", "i", "j", "block", "band", "d", "root", "n"]
            g = {c: t.column(c).to_numpy() for c in names}
            maps = _Maps(t.column("bitmap"))
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([g[c][1:] != g[c][:-1] for c in names[:4]], axis=0)
            edges = np.append(np.flatnonzero(new), t.num_rows)
            a_out, b_out = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                root, n, d = g["root"][lo:hi], g["n"][lo:hi], g["d"][lo:hi]
                if (root == root[0]).all():
                    continue
                low, blk = g["band"][lo:hi] == g["tile"][lo], g["block"][lo:hi]
                alone = g["i"][lo] == g["j"][lo]
                bits = maps.rows(np.arange(lo, hi), int(maps.words[lo:hi].min()))
                order = np.argsort(n, kind="stable")
                ends = np.searchsorted(n[order], n[order] * 100 // PERCENT, "right")
                nearest, partner = np.zeros(hi - lo), np.full(hi - lo, -1)
                for at, x in enumerate(order.tolist()):
                    # partners are larger, up to 1/t times, and not both in the upper band
                    y = order[at + 1: ends[at]]
                    y = y[(root[y] != root[x]) & (low[x] | low[y]) & (alone | (blk[y] != blk[x]))]
                    if not len(y):
                        continue
                    inner = _most_common(bits[x], bits[y], n[x], n[y])
                    ok = _reaches(inner, n[x], n[y])
                    y, inner = y[ok], inner[ok]
                    if every:
                        a_out.append(np.minimum(d[x], d[y]))
                        b_out.append(np.maximum(d[x], d[y]))
                    elif len(y):
                        like = inner / (n[x] + n[y] - inner)
                        top = like.argmax()
                        if like[top] > nearest[x]:
                            nearest[x], partner[x] = like[top], y[top]
                        nearer = like > nearest[y]
                        nearest[y[nearer]], partner[y[nearer]] = like[nearer], x
                if not every:
                    some = np.flatnonzero(partner >= 0)
                    a_out.append(np.minimum(d[some], d[partner[some]]))
                    b_out.append(np.maximum(d[some], d[partner[some]]))
            a_all, b_all = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a_out, b_out))
            return pa.RecordBatch.from_arrays([pa.array(a_all), pa.array(b_all)], names=["a", "b"])

        for x in batches:
            t = pa.Table.from_batches([x])
            if held is not None:
                t = pa.concat_tables([held, t])
            last = [t.column(c)[-1].as_py() for c in ("shingle", "tile", "i", "j")]
            same = np.ones(t.num_rows, bool)
            for c, v in zip(("shingle", "tile", "i", "j"), last):
                same &= t.column(c).to_numpy() == v
            cut = t.num_rows - int(same.sum())
            if cut:
                yield work(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield work(held)

    with wide_rows(tiles.sparkSession, 1024):
        return write_shared(dealt.mapInArrow(run, "a bigint, b bigint").distinct(), "open")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable from each node of ``edges``
    ``(a, b)``, by large-star and small-star rounds. A node with very many
    neighbours is summed up before it is shuffled."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")) if large else \
            e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.join(least, "u")
        if large:
            out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return write_shared(out.filter("a <> b").distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = write_shared(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    now = state(e)
    while now[0]:
        e = star(star(e, True), False)
        before, now = now, state(e)
        if now == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def join(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` of every document.

    A set holds the distinct ``SHINGLE``-word shingles of the whole text (A-Z
    lower-cased); with fewer words the word sequence is its one element; without
    words, or a null text, it is empty and linked with nothing. Documents link
    at ``100 * intersection >= PERCENT * union``. ``component_id`` is the
    smallest id reachable by links, the document's own included (null only if
    all are null). Repeated rows come out as often as they go in; other columns
    are ignored; an empty table gives an empty table. Nothing is capped: tiles
    of any size are compared in blocks.
    """
    docs, common = signatures(documents, key, text)
    sig = write_shared(docs.filter("n > 0").groupBy("d").agg(
        F.min("id").alias("least"), F.min("jk").alias("jk"), F.first("n").alias("n"),
        F.first("bitmap").alias("bitmap")), "distinct")
    tiles = write_shared(_tiles(_prefixes(documents, key, text, common)), "tiles")
    near = _near(tiles.filter("d <> lead").select(F.col("lead").alias("a"), F.col("d").alias("b")).distinct(), sig)
    ends = near.select(F.col("a").alias("d")).union(near.select(F.col("b").alias("d")))
    roots = write_shared(components(_links(near, _sets_of(ends, sig, documents, key, text))), "roots")
    nearest = _open(tiles, roots, sig, every=False)
    if not nearest.isEmpty():
        # whoever is in any open pair is in a nearest one
        left = write_shared(nearest.select(F.col("a").alias("d")).union(nearest.select("b")).distinct(), "left")
        sets = _sets_of(left, sig, documents, key, text)
        tiles = write_shared(tiles.join(left, "d", "left_semi"), "open-tiles")
        for _ in range(TURNS):
            roots = _merged(roots, _links(nearest, sets))
            nearest = _open(tiles, roots, sig, every=False)
        roots = _merged(roots, _links(_open(tiles, roots, sig, every=True), sets))
    named = (sig.select("d", "least").join(roots.withColumnRenamed("node", "d"), "d", "left")
             .withColumn("root", F.coalesce("root", "d")))
    ids = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("d", "component_id")
    return (docs.join(ids, "d", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))
