"""Word vectors from co-occurrence: pair counts in a window, their positive mutual
information, and its principal coordinates. Texts stay where they are; what is
shuffled is a row per pair of vocabulary words and batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.constants import ENGLISH_STOP_WORDS, MAX_FEATURES
from agora.functions.text import remove_stop_words, tokenize
from agora.operators import vectors as VO
from agora.session import write_shared

#: Tokens of one step of counting.
_TOKENS = 1 << 20


def _pairs(terms: pa.Array, window: int):
    size = len(terms)

    def run(batches):
        for batch in batches:
            tokens = batch.column(0)
            flat, row = tokens.flatten(), pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
            code = pc.index_in(flat, terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(code), _TOKENS):
                first = np.arange(lo, min(len(code), lo + _TOKENS))
                keys = []
                for lag in range(1, window + 1):
                    x = first[first + lag < len(code)]
                    x = x[(row[x] == row[x + lag]) & (code[x] >= 0) & (code[x + lag] >= 0)]
                    a, b = code[x], code[x + lag]
                    keys.append(np.minimum(a, b) * size + np.maximum(a, b))
                both, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both // size), pa.array(both % size), pa.array(n.astype(np.int64))],
                                                 names=["a", "b", "n"])
    return run


def word_pairs(docs: DataFrame, vocab: DataFrame, text_col: str = "text", window: int = 5,
               stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(a, b, n)``, a <= b: how often two words of ``vocab`` ``(term)`` stand at most
    ``window`` tokens apart in a text (row of ``docs``), either first. Stop words are
    left out before; words that are not in the vocabulary keep their place. Null and
    empty texts have no pairs.

    The vocabulary is sent to all tasks and may have ``MAX_FEATURES`` terms at most."""
    terms = vocab.filter("term is not null").select("term").distinct().orderBy("term").limit(MAX_FEATURES + 1).toArrow()
    if terms.num_rows > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} terms")
    known = terms.column("term").combine_chunks().cast(pa.string())
    tokens = docs.filter(F.col(text_col).isNotNull()).select(
        remove_stop_words(tokenize(F.col(text_col)), stop_words).alias("tokens"))
    counted = tokens.mapInArrow(_pairs(known, window), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(
        F.sum("n").alias("n"))
    names = docs.sparkSession.createDataFrame(pd.DataFrame({"code": np.arange(len(known)), "term": known.to_pylist()}),
                                              "code bigint, term string")
    name = lambda c: F.broadcast(names.select(F.col("code").alias(c), F.col("term").alias(f"{c}_term")))
    return counted.join(name("a"), "a").join(name("b"), "b").select(
        F.col("a_term").alias("a"), F.col("b_term").alias("b"), "n")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Ordered pairs: a pair of equal words counts for both of them."""
    twice = F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("n")
    return pairs.select("a", "b", twice).union(pairs.filter("a <> b").select("b", "a", "n"))


def positive_information(pairs: DataFrame) -> DataFrame:
    """``(a, b, n, information)``: max(0, log(n T / (n_a n_b))) of each pair, with the
    counts of ordered pairs: n_a of those that start with a, T of all."""
    ways = _both_ways(pairs)
    words = ways.groupBy("a").agg(F.sum("n").cast("double").alias("n_word"))
    total = words.agg(F.sum("n_word").alias("total"))
    side = lambda c: words.select(F.col("a").alias(c), F.col("n_word").alias(f"n_{c}"))
    n = F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).cast("double")
    info = F.log(n * F.col("total") / (F.col("n_a") * F.col("n_b")))
    return pairs.join(side("a"), "a").join(side("b"), "b").join(F.broadcast(total)).select(
        "a", "b", "n", F.greatest(info, F.lit(0.0)).alias("information"))


def word_vectors(pairs: DataFrame, k: int = 100) -> DataFrame:
    """``(term, embedding)``: each word's row of the matrix of positive information, on
    the matrix' ``k`` principal axes (fewer if there are fewer words), found by the
    randomised range finder. A row has at most ``MAX_FEATURES`` places, as the vocabulary."""
    info = write_shared(positive_information(pairs).select("a", "b", "information"), "information")
    ways = info.union(info.filter("a <> b").select("b", "a", "information"))
    names = sorted(r[0] for r in ways.select("a").distinct().collect())  # the vocabulary
    if not names:
        return ways.select(F.col("a").alias("term"), F.array().cast("array<double>").alias("embedding"))
    place = ways.sparkSession.createDataFrame([(t, i) for i, t in enumerate(names)], "b string, place int")
    entries = ways.join(F.broadcast(place), "b").groupBy(F.col("a").alias("term")).agg(
        F.collect_list(F.struct("place", "information")).alias("entries"))
    width = len(names)

    @F.pandas_udf("array<double>")
    def dense(entries: pd.Series) -> pd.Series:
        def row(e):
            out = np.zeros(width)
            for x in e:
                out[x["place"]] = x["information"]
            return out
        return entries.map(row)

    rows = write_shared(entries.select("term", dense("entries").alias("row")), "rows")
    axes = VO.principal_axes(rows, min(k, width), "row")
    return VO.project(rows, axes, "row", "embedding").select("term", "embedding")


def word_topic_vectors(words: DataFrame, word_vecs: DataFrame) -> DataFrame:
    """``(topic, embedding)`` in the space of the words: the mean vector of a topic's
    ``(topic, term, score)`` words, weighted by score. Words without a vector are left out."""
    j = words.select("topic", "term", "score").filter("score > 0").join(word_vecs, "term")
    return j.groupBy("topic").agg(VO.weighted_mean("embedding", "score").alias("embedding"))
