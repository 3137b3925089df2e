"""Chunked sentiment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.functions.constants import CHUNK_WORDS, NOISE, SENTIMENT_CLASSES
from agora.functions.text import tokenize, word_chunks

# The default lexicon scorer's word lists (a small English
# polarity lexicon; the class is the sign of positive − negative hits).
POSITIVE_WORDS = (
    "good", "great", "excellent", "positive", "success", "successful", "benefit", "benefits",
    "improve", "improved", "hope", "hopeful", "support", "win", "progress", "clean", "safe",
    "happy", "love", "best", "better", "strong", "effective", "opportunity", "solution",
)
NEGATIVE_WORDS = (
    "bad", "poor", "terrible", "negative", "fail", "failure", "crisis", "risk", "danger",
    "dangerous", "threat", "harm", "damage", "disaster", "worse", "worst", "fear", "loss",
    "hate", "problem", "collapse", "scam", "lies", "hysteria", "burden",
)


def chunk_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                size: int = CHUNK_WORDS) -> DataFrame:
    """``(doc_id, chunk_no, chunk)`` — consecutive runs of ``size``
    whitespace-separated words. Row-local: no shuffle."""
    return docs.select(id_col, F.posexplode(word_chunks(F.col(text_col), size)).alias("chunk_no", "chunk"))


def lexicon_sentiment(chunks: DataFrame, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS,
                      text_col: str = "chunk") -> DataFrame:
    """F12 default scorer: score = positive − negative hits among the chunk's
    tokens (hash-set lookups inside the row); class by the sign."""
    sign = F.create_map(*[F.lit(v) for w in positive for v in (w, 1)], *[F.lit(v) for w in negative for v in (w, -1)])
    # a token's hit is looked up once; as a column of its own the score isn't worked out again for the class
    scored = chunks.withColumn("score", F.aggregate(
        F.filter(tokenize(F.col(text_col)), lambda t: t.isin([*positive, *negative])), F.lit(0).cast("bigint"),
        lambda total, t: total + F.element_at(sign, t)))
    cls = F.when(F.col("score") < 0, F.lit(SENTIMENT_CLASSES[0])).when(F.col("score") > 0, F.lit(SENTIMENT_CLASSES[2])) \
        .otherwise(F.lit(SENTIMENT_CLASSES[1]))
    return scored.withColumn("sentiment", cls)


def model_sentiment(chunks: DataFrame, scorer: Callable[[list[str]], np.ndarray],
                    text_col: str = "chunk", batch_size: int = 32) -> DataFrame:
    """F12 with a model: ``scorer(texts) -> (n, 3) logits`` (Negative,
    Neutral, Positive) over Arrow batches; class = argmax."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("sentiment", T.StringType())])

    def run(batches):
        for pdf in batches:
            out = []
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                if part.empty:
                    continue
                logits = np.asarray(scorer(part[text_col].tolist()))
                out.append(part.assign(sentiment=[SENTIMENT_CLASSES[i] for i in logits.argmax(axis=1)]))
            if out:
                yield pd.concat(out)

    return chunks.mapInPandas(run, schema)


def topic_sentiment(scored: DataFrame, doc_topics: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """per topic, the share of its chunks in each class
    ``(topic, negative, neutral, positive, chunks)``; noise excluded."""
    j = scored.select(id_col, "sentiment").join(
        doc_topics.where(F.col("topic") != NOISE).select(id_col, "topic"), id_col)
    n = F.count(F.lit(1))
    return j.groupBy("topic").agg(
        *[(F.sum(F.when(F.col("sentiment") == c, 1).otherwise(0)) / n).alias(c.lower())
          for c in SENTIMENT_CLASSES],
        n.alias("chunks"))
