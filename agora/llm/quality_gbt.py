"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (byte classes, words, repetition) are cut into at most
``BINS`` quantile bins; trees grow level by level from histograms of gradients,
and are kept as full binary trees flattened into arrays, so scoring is a few
numpy gathers for a block of rows and all trees at once.

The classifier is fitted on at most ``SAMPLE`` labelled rows (a documented bound:
their statistics, a few megabytes, are all that reaches the driver), chosen by a
hash of the id. Every row is scored, over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.common import Texts, slices, texts_of

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.2, 1.0

FEATURES = ["log_chars", "log_words", "word_length", "spaces", "newlines", "upper", "lower", "digits",
            "non_ascii", "punctuation", "stops_commas", "top_punctuation", "byte_entropy", "distinct_bytes",
            "words_ending_odd", "words_all_upper", "distinct_words", "top_word", "word_again", "distinct_trigrams",
            "short_words", "long_words"]

_CLASS = np.zeros(256, np.uint8)  # 0 other punctuation and control
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 5
_CLASS[[46, 44]] = 6  # . ,


def _distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of one value, per row."""
    n = len(rows) - 1
    distinct, top = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
        if b > a:
            s = np.sort(values[a:b])
            edge = np.flatnonzero(s[1:] != s[:-1])
            distinct[i] = len(edge) + 1
            top[i] = np.diff(np.concatenate(([-1], edge, [b - a - 1]))).max()
    return distinct, top


def statistics(texts: Texts) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros."""
    buf, bounds = texts.buf, texts.bounds
    n = len(bounds) - 1
    size = np.diff(bounds)
    row = np.repeat(np.arange(n), size)
    histogram = np.bincount(row * 256 + buf, minlength=n * 256).reshape(n, 256)
    total = np.maximum(size, 1)[:, None]
    by_class = np.stack([histogram[:, _CLASS == c].sum(axis=1) for c in range(7)], axis=1) / total
    chars = size - histogram[:, 128:192].sum(axis=1)
    p = histogram / total
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    starts, first = texts.words()
    words = np.diff(first)
    w = np.maximum(words, 1)
    word_row = np.repeat(np.arange(n), words)
    per_row = lambda m: np.bincount(word_row, weights=m, minlength=n) / w
    kind = _CLASS[buf]
    # the length of a word: bytes that aren't space up to the next word's start
    ink = np.concatenate(([0], np.cumsum(kind != 5)))
    ends = np.append(starts[1:], len(buf))
    length = ink[ends] - ink[starts]
    odd = kind[np.maximum(starts + length - 1, 0)] == 0
    low = np.concatenate(([0], np.cumsum(kind == 2)))
    up = np.concatenate(([0], np.cumsum(kind == 1)))
    shout = (low[ends] == low[starts]) & (up[ends] - up[starts] > 1)
    hashes, _ = texts.word_hashes()
    distinct, top = _distinct(hashes, first)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    three = hashes.copy()
    three[2:] += hashes[1:-1] * np.uint64(3) + hashes[:-2] * np.uint64(7)
    trigrams, _ = _distinct(three, first)
    return np.stack([
        np.log1p(chars), np.log1p(words), per_row(length), by_class[:, 5], histogram[:, 10] / total[:, 0],
        by_class[:, 1], by_class[:, 2], by_class[:, 3], by_class[:, 4], by_class[:, 0], by_class[:, 6],
        (histogram * (_CLASS == 0)).max(axis=1) / total[:, 0], entropy, (histogram > 0).sum(axis=1),
        per_row(odd), per_row(shout), distinct / w, top / w, per_row(again), trigrams / w,
        per_row(length <= 3), per_row(length >= 15)], axis=1).astype(np.float32)


@dataclass
class Forest:
    """Full binary trees in arrays: node ``i`` of a tree has children ``2i+1``
    (value <= threshold) and ``2i+2``; a node that was not split sends all left."""

    feature: np.ndarray    # trees x (2^depth - 1)
    threshold: np.ndarray  # trees x (2^depth - 1)
    leaf: np.ndarray       # trees x 2^depth
    base: float

    def raw(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = int(np.log2(inner + 1))
        out = np.empty(len(x))
        first = np.arange(trees) * inner
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        for lo in range(0, len(x), block):
            part = x[lo: lo + block]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                at = first + node
                right = np.take_along_axis(part, feature[at], axis=1) > threshold[at]
                node = 2 * node + 1 + right
            leaf = self.leaf.ravel()[np.arange(trees) * self.leaf.shape[1] + node - inner]
            out[lo: lo + block] = self.base + leaf.sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
        rate: float = RATE, l2: float = L2) -> Forest:
    """Boost trees on logistic loss. Without rows, or with one label only, the
    forest has no split and scores the (smoothed) share of ones."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner = 2 ** depth - 1
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32),
                 np.zeros((trees, inner + 1)), base)
    if n == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(m)]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k = 2 ** level
            best = np.full(k, 1e-6)
            where, cut = np.zeros(k, np.int64), np.full(k, np.inf)
            for f in range(m):
                if not len(cuts[f]):
                    continue
                at = node * bins + code[:, f]
                gh = [np.bincount(at, weights=v, minlength=k * bins).reshape(k, bins).cumsum(axis=1) for v in (g, h)]
                (gl, hl), (ga, ha) = [v[:, :-1] for v in gh], [v[:, -1:] for v in gh]
                gain = gl**2 / (hl + l2) + (ga - gl)**2 / (ha - hl + l2) - ga**2 / (ha + l2)
                b = gain.argmax(axis=1)
                top = gain[np.arange(k), b]
                better = (top > best) & (b < len(cuts[f]))
                best[better], where[better] = top[better], f
                cut[better] = cuts[f][b[better]]
            place = k - 1 + np.arange(k)
            out.feature[t, place], out.threshold[t, place] = where, cut
            node = 2 * node + (x[np.arange(n), where[node]] > cut.astype(np.float32)[node])
        gs, hs = (np.bincount(node, weights=v, minlength=inner + 1) for v in (g, h))
        out.leaf[t] = -rate * gs / (hs + l2)
        margin += out.leaf[t][node]
    return out


def _with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without the text, with ``statistics`` (array of float)."""
    kept = rows.drop(text)

    def run(batches):
        for part in slices(batches, text):
            x = statistics(texts_of(part.column(text)))
            rest = part.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
                names=[*rest.schema.names, "statistics"])

    return rows.select(*kept.columns, text).mapInArrow(run, T.StructType([
        *kept.schema.fields, T.StructField("statistics", T.ArrayType(T.FloatType()))]))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE, **settings) -> Forest:
    """Fit on at most ``sample`` labelled documents, those with the smallest
    hash of their id. Rows with a null id or label are left out; an id with
    several labels counts with the smallest."""
    chosen = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(key).alias("__key")).agg(F.min(F.col(label)).cast("int").alias("__label"))
              .orderBy(F.xxhash64("__key"), "__key").limit(sample))
    # at most `sample` rows of two numbers: bounded, so it may be broadcast
    joined = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    rows = _with_statistics(joined, "__text").orderBy(F.xxhash64("__key"), "__key", "statistics").limit(sample).collect()
    x = np.array([r["statistics"] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["__label"] for r in rows], float), **settings)


def score(documents: DataFrame, forest: Forest, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``documents`` with ``score`` (0 to 1, higher: label 1 likelier) and
    ``predicted`` (1 if score >= 0.5). Null and empty texts are scored by their
    (zero) statistics. Input columns named like the added ones are replaced;
    ``keep_text=False`` leaves the text out of the result."""
    rows = documents.drop(*({"score", "predicted"} - {text}))

    def run(batches):
        for part in slices(batches, text):
            s = forest.score(statistics(texts_of(part.column(text))))
            rest = part if keep_text else part.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[*rest.schema.names, "score", "predicted"])

    fields = [f for f in rows.schema.fields if keep_text or f.name != text]
    return rows.mapInArrow(run, T.StructType([
        *fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
