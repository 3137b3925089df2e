"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from a hash of its code point.
An n-gram binds its letters' vectors, each permuted (rotated) by its place:
rot^2(a) * rot(b) * c. A document bundles (sums) the vectors of its letter
trigrams, a language bundles its training documents, and a document is given the
language whose prototype has the largest cosine with it, or none (``und``) if that
is within the noise of unrelated texts.

Letters are Unicode letters, lower-cased; every run of other characters is one
blank, and blanks count as a letter, so word beginnings and ends are learnt too.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.common import hashed, slices

#: Components of the hypervectors.
DIM = 1024
#: Distinct n-grams whose vectors are held at once.
_COLUMNS = 4096
UNKNOWN = "und"
#: The cosine of unrelated bundles scatters by 1 / sqrt(dim) around 0; a text
#: counts as known from this many times that on (0.125 at 1,024 components).
NOISE = 4.0

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in each Python worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)),
                               bool, sys.maxunicode + 1)
    return _letters


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Rows of +1 and -1 from a hash of (code point, component block)."""
    words = hashed(codes.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(dim // 64, dtype=np.uint64), 5)
    bits = np.unpackbits(words.view(np.uint8), axis=1, count=dim)
    return bits.astype(np.float32) * 2 - 1


def _compact(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and each value's place among them: by a table
    where the values' bound is small, else by sorting."""
    if bound > 1 << 22:
        return np.unique(values, return_inverse=True)
    there = np.zeros(bound, bool)
    there[values] = True
    distinct = np.flatnonzero(there)
    place = np.zeros(bound, np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[values]


class Trigrams:
    """Trigram counts of a block of texts, and their bundles."""

    def __init__(self, texts: list[str]):
        # a blank on both sides: the shortest text with a letter has a trigram
        codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        rows = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        is_letter = _letter_table()[flat]
        # of each run of non-letters the first one stays, as the blank 0
        first = np.ones(len(flat), bool)
        first[1:] = is_letter[:-1] | (rows[1:] != rows[:-1])
        keep = is_letter | first
        self.codes, at = _compact(np.where(is_letter, flat, 0)[keep], sys.maxunicode + 1)
        rows = rows[keep]
        n, k = len(texts), len(self.codes)
        whole = rows[2:] == rows[:-2]
        grams = (at[:-2].astype(np.int64) * k + at[1:-1]) * k + at[2:]
        self.has_letter = np.bincount(rows[is_letter[keep]], minlength=n) > 0
        self.rows = rows[2:][whole]
        self.grams, self.column = _compact(grams[whole], k**3)
        self.n = n

    def bundles(self, dim: int = DIM) -> np.ndarray:
        """One bundle per text. N-gram vectors are made for a bounded number of
        distinct n-grams at a time."""
        letters, k = letter_vectors(self.codes, dim), max(1, len(self.codes))
        out = np.zeros((self.n, dim), np.float32)
        for lo in range(0, len(self.grams), _COLUMNS):
            g = self.grams[lo: lo + _COLUMNS]
            bound = (np.roll(letters[g // (k * k)], 2, axis=1) * np.roll(letters[g // k % k], 1, axis=1)
                     * letters[g % k])
            inside = (self.column >= lo) & (self.column < lo + _COLUMNS)
            counts = np.bincount(self.rows[inside].astype(np.int64) * len(g) + self.column[inside] - lo,
                                 minlength=self.n * len(g)).reshape(self.n, len(g))
            out += counts.astype(np.float32) @ bound
        return out


def _block_bundles(batches, text: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in slices(batches, text):
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            t = Trigrams([x or "" for x in part.column(text).to_pylist()])
            yield part, t.bundles(dim), t.has_letter


def profiles(labelled: DataFrame, text: str, lang: str, dim: int = DIM) -> DataFrame:
    """``(lang, n, prototype)``: the bundle of each language's documents, every
    document brought to length 1 first. Tasks bundle on their own; only one
    vector per task and language is shuffled."""
    def local(batches):
        sums: dict[str, np.ndarray] = {}
        for part, bundles, has in _block_bundles(batches, "text", dim):
            unit = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
            names = np.array(part.column("lang").to_pylist(), object)
            for name in set(names[has]):
                mine = (names == name) & has
                total = sums.setdefault(name, np.zeros(dim + 1))
                total[:dim] += unit[mine].sum(axis=0)
                total[dim] += mine.sum()
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"lang": list(sums), "bundle": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    parts = rows.mapInArrow(local, "lang string, bundle array<double>")
    total = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return (total.groupBy("lang").agg(vector.alias("v"))
            .select("lang", F.col("v")[dim].cast("long").alias("n"), F.slice("v", 1, dim).alias("prototype")))


def identify(documents: DataFrame, prototypes: DataFrame, text: str = "text", dim: int = DIM,
             max_languages: int = 4096, keep_text: bool = True) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``lang_known`` added.

    ``prototypes`` (one row per language; more than ``max_languages`` is an
    error, so what goes to each task is at most ``max_languages * dim`` numbers)
    as made by :func:`profiles`. Every text with a letter gets the language of the
    best prototype; the score is the cosine with it (0 if negative), and ties go to
    the first language by code point. ``lang_known`` is false where the score is
    below ``NOISE / sqrt(dim)``, as texts in none of the languages have it. A text
    that is null or has no letter gets ``und``, score 0 and false, as does every
    text if there is no prototype.
    Input columns named like the added ones are replaced; ``keep_text=False``
    leaves the text out of the result.
    """
    known = prototypes.orderBy("lang").limit(max_languages + 1).collect()
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = [r["lang"] for r in known]
    p = np.array([r["prototype"] for r in known], np.float32).reshape(len(known), dim)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    least = NOISE / dim ** 0.5
    rows = documents.drop(*({"lang_pred", "score", "lang_known"} - {text}))

    def score(batches):
        for part, bundles, has in _block_bundles(batches, text, dim):
            if names:
                length = np.linalg.norm(bundles, axis=1)
                cosine = bundles @ p.T / np.maximum(length, 1e-9)[:, None]
                top = np.where(has & (length > 0), np.clip(cosine.max(axis=1), 0, 1), 0.0)
                said = [names[b] if ok else UNKNOWN for b, ok in zip(cosine.argmax(axis=1), has)]
            else:
                said, top = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            rest = part if keep_text else part.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(said, pa.string()), pa.array(top, pa.float64()), pa.array(top >= least)],
                names=[*rest.schema.names, "lang_pred", "score", "lang_known"])

    fields = [f for f in rows.schema.fields if keep_text or f.name != text]
    return rows.mapInArrow(score, T.StructType([
        *fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("lang_known", T.BooleanType())]))
