"""Shared pieces: whole-text word splitting and hashing over Arrow buffers,
folds, and small column helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id is fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def word_count(text: str) -> Column:
    """Number of words, in the JVM: where a word begins, the characters before
    and at the place are (space or nothing, not space). Null counts 0."""
    spaced = F.translate(F.col(text), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hashed(values: np.ndarray, seed: int) -> np.ndarray:
    h = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    return mix64(h)


_BYTES = hashed(np.arange(256), 17)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_BYTES[_IS_SPACE] = 0
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd multiplier, kept up to the longest word seen so far."""
    global _POWERS
    if len(_POWERS) < n:
        m = max(64, 1 << (n - 1).bit_length())
        p = np.full(m, 0xD1342543DE82EF95, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


class Texts:
    """UTF-8 texts of some rows: one byte buffer and the rows' bounds in it."""

    __slots__ = ("buf", "bounds")

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf, self.bounds = buf, bounds

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte position where each word begins; for each row (and at the
        end) the index of its first word."""
        letter = ~_IS_SPACE[self.buf]
        begins = letter.copy()
        if len(begins):
            begins[1:] &= ~letter[:-1]
            first = self.bounds[:-1][self.bounds[:-1] < len(begins)]
            begins[first] = letter[first]
        starts = np.flatnonzero(begins)
        return starts, np.searchsorted(starts, self.bounds)

    def word_hashes(self, step: int = 1 << 22, words: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of each word with A-Z lower-cased; rows' first words. ``words``:
        what :meth:`words` gave, if it is known.

        Works through the buffer in runs of whole words of about ``step``
        bytes, so one very long text needs no more memory than many short."""
        starts, rows = words or self.words()
        out = np.empty(len(starts), np.uint64)
        ends = np.append(starts, len(self.buf))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + step)))
            a, b = starts[i], ends[j]
            own = starts[i:j] - a
            at = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
            # the hash must not depend on the spaces that follow: they count 0
            out[i:j] = np.add.reduceat(_BYTES[self.buf[a:b]] * _powers(int(at.max()) + 1)[at], own)
            i = j
        return mix64(out), rows


def texts_of(column: pa.Array) -> Texts:
    """A string column's rows; a null counts as an empty text."""
    a = column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    _, off, data = a.buffers()
    bounds = np.frombuffer(off, np.int64)[a.offset: a.offset + len(a) + 1]
    buf = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return Texts(buf, bounds - bounds[0])


#: What operators keep in a Python worker from task to task.
CACHES: list[dict] = []


def slices(batches, text: str, max_bytes: int = 1 << 20, cache: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``max_bytes`` of text (one
    row at least), so a task's memory doesn't follow the batch size. Caches that
    other operators left in this worker are dropped first, all but ``cache``."""
    for c in CACHES:
        if c and c is not cache:
            c.clear()
    release()  # what an earlier stage's task left free in this worker
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bounds = texts_of(batch.column(text)).bounds
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + max_bytes, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    release()


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """Plans run inside give Python ``rows`` rows at a time: for rows that may hold
    whole sets of very long texts, of which ten thousand don't fit into memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give free memory back to the system: a Python worker lives on from task to
    task, and what its allocators keep would add up over stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each row's set of ``k``-word shingles as a sorted array of 64-bit hashes;
    with fewer words the whole sequence is one shingle, without any the set is
    empty."""
    n = len(hashes)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k if n >= k else 0):
        full *= odd
        full += hashes[i: n - k + 1 + i]
    mix64(full)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(full[a: b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in hashes[a:b]:
                h = mix64(h * odd + w)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list column of one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
