"""Document fingerprints from closed syncmers.

A k-mer of code points is kept if the smallest hash of its s-mers stands at
either edge. Whether a k-mer is kept depends on nothing outside it, so an edit
moves or destroys only the anchors that it touches. Two texts are compared on all
their distinct anchors, each at the place of its first occurrence: those count
that both have and that stand in the same order in both texts. The fingerprint
that is written is whole: it holds every distinct anchor and its place, so likeness
can be read from two written fingerprints alone.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.common import mix64, slices
from agora.session import write_shared

K, S = 12, 6
#: Anchors that a short text has at most; nothing is cut at this number.
ANCHORS = 64
_ODD = 0x9E3779B97F4A7C15


def anchors(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes (32 bits, ascending, distinct) and first places
    of its closed syncmers. A text shorter than K has one anchor, its hash at
    place 0; an empty one has none."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.empty(0, np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64)
    n = len(flat) - S + 1
    inner = np.zeros(max(0, n), np.uint64)
    for j in range(S if n > 0 else 0):
        inner *= np.uint64(_ODD)
        inner += flat[j: n + j]
    mix64(inner)
    width = K - S + 1
    m = len(inner) - width + 1
    if m > 0:
        least, have = inner, 1
        while have < width:  # minimum over windows of doubling width
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        kept = np.flatnonzero((inner[:m] == least) | (inner[width - 1:] == least))
        hashes = mix64(inner[kept] * np.uint64(3) + inner[kept + (K - S)] * np.uint64(_ODD)) >> np.uint64(32)
    else:
        kept, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
    lo = np.searchsorted(kept, bounds[:-1])
    hi = np.searchsorted(kept, bounds[1:] - K, "right")
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
        size = bounds[i + 1] - bounds[i]
        if size >= K:
            values, first = np.unique(hashes[a:b], return_index=True)
            yield values, kept[a:b][first] - bounds[i]
        elif size:
            h = int.from_bytes(hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).digest()[:4], "big")
            yield np.array([h], np.uint64), np.zeros(1, np.int64)
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)


_LETTERS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~", np.uint8)
_DIGIT = np.zeros(256, np.uint32)
_DIGIT[_LETTERS] = np.arange(85)
_PLACES = np.uint32(85) ** np.arange(4, -1, -1, dtype=np.uint32)
#: Steps from one anchor to the next that have a code of their own; two codes are a digit of base 85.
_STEPS = 8


def _five(numbers: np.ndarray) -> np.ndarray:
    """Five digits of base 85 for each number below 2^32."""
    return (numbers.astype(np.uint32)[:, None] // _PLACES % np.uint32(85)).ravel()


def _number(digits: np.ndarray) -> np.ndarray:
    return (digits.reshape(-1, 5) * _PLACES).sum(axis=1, dtype=np.uint32)


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """All anchors in order of their places, in digits of base 85: their number, five
    digits of hash for each, a digit for the steps to two of them from those before
    (each of 1 to ``_STEPS``, or 0), and five for each step that is 0 there."""
    n = len(hashes)
    if not n:
        return ""
    order = np.argsort(places, kind="stable")
    steps = np.diff(places[order], prepend=-1)
    code = np.where((steps >= 1) & (steps <= _STEPS), steps, 0)
    two = np.append(code, 0)[: n + n % 2].reshape(-1, 2)
    digits = np.concatenate([_five(np.array([n])), _five(hashes[order]),
                             two[:, 0] * (_STEPS + 1) + two[:, 1], _five(steps[code == 0])])
    return _LETTERS[digits.astype(np.uint8)].tobytes().decode("ascii")


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (ascending) and places that were written."""
    digits = _DIGIT[np.frombuffer(fingerprint.encode("ascii"), np.uint8)]
    if not len(digits):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = int(_number(digits[:5])[0])
    ends = np.cumsum([5, 5 * n, (n + 1) // 2])
    hashes = _number(digits[ends[0]: ends[1]]).astype(np.uint64)
    steps = np.stack(np.divmod(digits[ends[1]: ends[2]].astype(np.int64), _STEPS + 1), axis=1).ravel()[:n]
    steps[steps == 0] = _number(digits[ends[2]:])
    order = np.argsort(hashes)
    return hashes[order], (np.cumsum(steps) - 1)[order]


def _longest_rise(p: np.ndarray) -> int:
    """Length of the longest rising subsequence of distinct numbers. A number above
    all before and below all after it is in every longest one; the rest is searched."""
    if not len(p):
        return 0
    before, after = np.maximum.accumulate(p), np.minimum.accumulate(p[::-1])[::-1]
    sure = (p == before) & (p == after)
    ends: list[int] = []
    for v in p[~sure].tolist():
        i = bisect.bisect_left(ends, v)
        ends[i: i + 1] = [v]
    return int(sure.sum()) + len(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchors of the union that both have in one order (longest run
    of places that rise in both). Two empty ones: 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    pa_, pb = a[1][both], b[1][at[both]]
    return _longest_rise(pb[np.argsort(pa_, kind="stable")]) / (len(a[0]) + len(b[0]) - len(pa_))


# ------------------------------------------------ each document and the next

def _range_of(splits: list[tuple[bool, int, int]]):
    """Range ``p`` holds the keys from ``splits[p]`` on; a range's first key also
    goes, as a guest, to the range before it (the first to the last one)."""
    ids = np.unique(np.array([s[1] for s in splits], np.int64))

    def run(batches):
        for b in batches:
            there = b.column("id").is_valid().to_numpy(zero_copy_only=False)
            key = b.column("id").fill_null(0).to_numpy()
            h = b.column("h").to_numpy()
            ranges, guests = [], []
            at = np.searchsorted(ids, key, "right")
            edge = np.isin(key, ids) | ~there
            seen = {}
            for i in range(b.num_rows):
                if edge[i]:
                    k = (bool(there[i]), int(key[i]), int(h[i]))
                    p = bisect.bisect_right(splits, k) - 1
                    first = splits[p] == k
                else:  # between two splitters: looked up once for each gap
                    p = seen.get(at[i])
                    if p is None:
                        p = seen[at[i]] = bisect.bisect_right(splits, (True, int(key[i]), int(h[i]))) - 1
                    first = False
                ranges.append([p, (p - 1) % len(splits)] if first else [p])
                guests.append([False, True] if first else [False])
            homes = pa.array([[{"range": p, "guest": g} for p, g in zip(r, gs)] for r, gs in zip(ranges, guests)],
                             pa.list_(pa.struct([("range", pa.int32()), ("guest", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([*b.columns, homes], names=[*b.schema.names, "homes"])
    return run


def with_next(documents: DataFrame, key: str = "doc_id", text: str = "text",
              range_bytes: int = 16 << 20, most_ranges: int = 16384) -> DataFrame:
    """Documents dealt into key ranges for :func:`neighbours`: ``id, text, range,
    guest``, sorted by key within each range, guests last.

    Ids are split into ranges of about ``range_bytes`` of text (64 ranges at
    least; at most ``most_ranges``, which bounds the list of range bounds on the
    driver; a range is streamed, never held). Text is shuffled once. Rows are in
    the order of (id, nulls first; hash of the text)."""
    d = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    keys = write_shared(d.select("id", "h", F.octet_length("text").cast("long").alias("bytes")), "keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    ranges = int(min(most_ranges, max(64, total // range_bytes)))
    order = [F.asc_nulls_first("id"), F.asc("h")]
    lows = (keys.select(F.struct(F.col("id").isNotNull().alias("there"), F.coalesce("id", F.lit(0)).alias("id"), "h").alias("k"), "id", "h")
            .repartitionByRange(ranges, *order)
            .groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).select("k.*").collect())
    splits = sorted((r["there"], r["id"], r["h"]) for r in lows)
    kind = T.ArrayType(T.StructType().add("range", T.IntegerType()).add("guest", T.BooleanType()))
    homed = d.mapInArrow(_range_of(splits or [(False, 0, 0)]), T.StructType([*d.schema.fields, T.StructField("homes", kind)]))
    return (homed.select("id", "text", "h", F.explode("homes").alias("home"))
            .select("id", "text", "h", "home.range", "home.guest")
            .repartitionById(max(1, len(splits)), F.col("range"))
            .sortWithinPartitions("range", "guest", *order))


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by the beginning of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` of every document and its successor by key.

    Null texts count as empty; null keys come first; after the last document
    comes the first; a single document is its own successor. Rows with equal key
    and text follow one another, rows with equal key are ordered by their text's
    hash. ``near_*`` are the likeness of the written fingerprints, which hold all
    anchors. Empty tables give an empty table; other columns are ignored.
    """
    def run(batches):
        carried = None  # the row that waits for its successor
        for part in slices(batches, "text"):
            rows = list(zip(part.column("id").to_pylist(), part.column("text").to_pylist(),
                            part.column("range").to_pylist(), part.column("guest").to_pylist()))
            rows = ([carried] if carried else []) + rows
            carried = rows[-1]
            pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            changed = [edited(rows[i][1], rows[i + 1][1]) for i in pairs]
            own = list(anchors([r[1] for r in rows]))
            new = list(anchors(changed))
            yield pa.RecordBatch.from_pydict({
                key: pa.array([rows[i][0] for i in pairs], pa.int64()),
                "n_chars": pa.array([len(rows[i][1]) for i in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
                "fingerprint": [written(*own[i]) for i in pairs],
                "edited_fingerprint": [written(*f) for f in new],
                "near_edited": pa.array([likeness(own[i], f) for i, f in zip(pairs, new)], pa.float64()),
                "near_next": pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
            }, schema=_schema(key))

    return with_next(documents, key, text).select("id", "text", "range", "guest").mapInArrow(
        run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def _schema(key: str) -> pa.Schema:
    return pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                      ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                      ("near_edited", pa.float64()), ("near_next", pa.float64())])
