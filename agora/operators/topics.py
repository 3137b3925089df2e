"""Topic model (G1–G10): class-based TF-IDF over given clusters, topic
words, topic/document tables, representative documents, embedding-aware
reranking, MMR and lexicon filtering."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import vectors as V
from agora.functions.constants import ENGLISH_STOP_WORDS, MAX_DF, MIN_DF, MMR_DIVERSITY, NOISE
from agora.operators.terms import count_topic_terms, prune_vocab, term_stats, top_n_per_group
from agora.operators.vectors import weighted_mean
from agora.session import write_shared


def topic_mapping(clusters: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """``(cluster, topic)``: clusters renumbered 0.. by descending size (ties by
    cluster id), noise left out. The ranking window runs over one row per cluster."""
    sizes = (clusters.where(F.col(cluster_col) != NOISE)
             .groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size")))
    return sizes.select(cluster_col, (F.row_number().over(
        Window.orderBy(F.desc("size"), F.asc(cluster_col))) - 1).alias("topic"))


def assign_topics(clusters: DataFrame, cluster_col: str = "cluster", id_col: str = "doc_id") -> DataFrame:
    """G1: renumber clusters 0.. by descending size (ties by cluster id);
    noise stays −1. The mapping join back is broadcast by AQE when the measured
    mapping is small and skew-split otherwise."""
    return (clusters.select(id_col, cluster_col).join(topic_mapping(clusters, cluster_col), cluster_col, "left")
            .select(id_col, F.coalesce(F.col("topic"), F.lit(NOISE)).alias("topic")))


def class_term_counts(docs: DataFrame, topics: DataFrame, text_col: str = "text",
                      id_col: str = "doc_id", min_n: int = 1, max_n: int = 1,
                      stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(topic, term, n)`` — term counts of all documents of a topic
    (n-grams never span two documents). Noise excluded. ``topics`` as in
    :func:`agora.operators.terms.count_topic_terms`."""
    return count_topic_terms(docs, topics, text_col, id_col, min_n, max_n, stop_words)


def prune_class_vocab(class_counts: DataFrame, min_df=MIN_DF, max_df=MAX_DF) -> DataFrame:
    """F5 with topics as units: keep terms present in ≥ min_df and
    ≤ max_df topics."""
    # read three times (topic count, term stats, the filter): written once, the
    # table is topics × vocabulary, already aggregated
    class_counts = write_shared(class_counts, "class-counts")
    n_topics = class_counts.select(F.countDistinct("topic")).scalar()
    vocab = prune_vocab(term_stats(class_counts, "topic"), n_topics, min_df, max_df).select("term")
    return class_counts.join(vocab, "term", "left_semi")


def ctfidf(class_counts: DataFrame) -> DataFrame:
    """``W = (n_tc / Σ_t n_tc) · ln(1 + A / f_t)`` with A = ⌊mean words
    per topic⌋ and f_t the term's count over all topics → ``(topic, term,
    score)``."""
    class_counts = write_shared(class_counts, "class-counts")
    row = class_counts.groupBy("topic").agg(F.sum("n").alias("row_n"))
    a = row.select(F.floor(F.avg("row_n")).cast("double")).scalar()
    ft = class_counts.groupBy("term").agg(F.sum("n").alias("f_t"))
    return (class_counts.join(row, "topic").join(ft, "term")
            .select("topic", "term",
                    (F.col("n") / F.col("row_n") * F.log(F.lit(1.0) + a / F.col("f_t"))).alias("score")))


def topic_words(scores: DataFrame, top_n: int = 10) -> DataFrame:
    """``(topic, rank, term, score)``; also serves ``get_topic``."""
    return top_n_per_group(scores, "topic", "score", top_n).select("topic", "rank", "term", "score")


def _ranked(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``(topic, out)``: each topic's values by rank, an array of a report's length."""
    return rows.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", value))).alias("_rows")).select(
        "topic", F.transform("_rows", lambda s: s[value]).alias(out))


def topic_info(doc_topics: DataFrame, words: DataFrame, name_words: int = 4,
               aspects: dict[str, DataFrame] | None = None, representatives: DataFrame | None = None,
               id_col: str = "doc_id") -> DataFrame:
    """Topic, count, name ``{id}_{w1}_{w2}_{w3}_{w4}``, representation (words
    joined by ', ', best first); then ``aspect_<name>`` for each further word table
    ``(topic, rank, term)``, written alike, and ``representative_docs`` (ids by rank)
    where ``(topic, rank, id)`` is given. A topic without words has empty strings,
    one without representatives an empty array."""
    none = F.array().cast("array<string>")
    out = doc_topics.groupBy("topic").agg(F.count(F.lit(1)).alias("count")).join(_ranked(words, "term", "_w"), "topic", "left")
    out = out.select("topic", "count", F.concat_ws("_", F.col("topic").cast("string"), F.array_join(
        F.slice(F.coalesce("_w", none), 1, name_words), "_")).alias("name"),
        F.array_join(F.coalesce("_w", none), ", ").alias("representation"))
    for name, table in (aspects or {}).items():
        out = out.join(_ranked(table, "term", "_w"), "topic", "left").withColumn(
            f"aspect_{name}", F.array_join(F.coalesce("_w", none), ", ")).drop("_w")
    if representatives is not None:
        kind = f"array<{representatives.schema[id_col].dataType.simpleString()}>"
        out = out.join(_ranked(representatives, id_col, "_d"), "topic", "left").withColumn(
            "representative_docs", F.coalesce("_d", F.array().cast(kind))).drop("_d")
    return out


def document_info(doc_topics: DataFrame, info: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document with its topic's name and words."""
    return doc_topics.select(id_col, "topic").join(
        info.select("topic", "name", "representation"), "topic", "left")


def representative_docs(vectors: DataFrame, doc_topics: DataFrame, topic_vecs: DataFrame,
                        n: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The ``n`` documents closest (cosine) to their topic vector."""
    j = (vectors.select(id_col, "embedding").join(doc_topics.select(id_col, "topic"), id_col)
         .join(topic_vecs.select("topic", F.col("embedding").alias("tv")), "topic"))
    s = j.select("topic", id_col, V.cosine("embedding", "tv").alias("similarity"))
    return top_n_per_group(s, "topic", "similarity", n, tie_cols=(id_col,)).select(
        "topic", "rank", id_col, "similarity")


def term_vectors(counts: DataFrame, vectors: DataFrame, terms: DataFrame,
                 id_col: str = "doc_id") -> DataFrame:
    """Corpus word vectors for a set of terms: the count-weighted mean vector of
    the documents containing the term (replaces a word encoder), in one buffer
    per term, map-side first. ``(term, embedding)``."""
    c = counts.join(terms.select("term").distinct(), "term", "left_semi").join(vectors.select(id_col, "embedding"), id_col)
    return c.groupBy("term").agg(weighted_mean("embedding", "n").alias("embedding"))


def rerank_by_embedding(candidates: DataFrame, term_vecs: DataFrame, topic_vecs: DataFrame,
                        top_n: int = 10) -> DataFrame:
    """Candidate words of each topic reordered by cosine(term vector,
    topic vector) → ``(topic, rank, term, score)``."""
    j = (candidates.select("topic", "term")
         .join(term_vecs.select("term", F.col("embedding").alias("wv")), "term")
         .join(topic_vecs.select("topic", F.col("embedding").alias("tv")), "topic"))
    s = j.select("topic", "term", V.cosine("wv", "tv").alias("score"))
    return top_n_per_group(s, "topic", "score", top_n).select("topic", "rank", "term", "score")


def _mmr_group(top_n: int, diversity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term").reset_index(drop=True)
        w = np.array(pdf["wv"].tolist(), dtype=np.float64)
        t = np.array(pdf["tv"].iloc[0], dtype=np.float64)

        def unit(m):
            n = np.linalg.norm(m, axis=-1, keepdims=True)
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        wu, tu = unit(w), unit(t)
        sim_t = wu @ tu
        sim_w = wu @ wu.T
        chosen = [int(np.argmax(np.round(sim_t, 12)))]
        rest = [i for i in range(len(pdf)) if i != chosen[0]]
        while rest and len(chosen) < top_n:
            red = sim_w[np.ix_(rest, chosen)].max(axis=1)
            score = (1 - diversity) * sim_t[rest] - diversity * red
            pick = rest[int(np.argmax(np.round(score, 12)))]
            chosen.append(pick)
            rest.remove(pick)
        return pd.DataFrame({"topic": pdf["topic"].iloc[0], "rank": np.arange(1, len(chosen) + 1),
                             "term": pdf["term"].iloc[chosen].to_numpy(),
                             "score": sim_t[chosen]})
    return run


def mmr(candidates: DataFrame, term_vecs: DataFrame, topic_vecs: DataFrame,
        top_n: int = 10, diversity: float = MMR_DIVERSITY, pool: int = 200) -> DataFrame:
    """Maximal marginal relevance — greedily pick the word maximising
    (1−δ)·sim(word, topic) − δ·max sim(word, chosen). One pandas group per
    topic, of the ``pool`` candidate words nearest to it at the most."""
    j = (candidates.select("topic", "term")
         .join(term_vecs.select("term", F.col("embedding").alias("wv")), "term")
         .join(topic_vecs.select("topic", F.col("embedding").alias("tv")), "topic"))
    j = top_n_per_group(j.withColumn("near", V.cosine("wv", "tv")), "topic", "near", pool)
    return j.select("topic", "term", "wv", "tv").groupBy("topic").applyInPandas(
        _mmr_group(top_n, diversity), "topic int, rank int, term string, score double")


def lexicon_filter(candidates: DataFrame, lexicon: DataFrame, allowed, tag_col: str = "tag") -> DataFrame:
    """Keep candidate words whose tag is allowed (tagger replaced by a
    ``(term, tag)`` table); order within each topic is kept."""
    lx = lexicon.where(F.col(tag_col).isin(list(allowed))).select("term")
    return candidates.join(lx, "term", "left_semi")


def majority_tag_lexicon(docs: DataFrame, counts: DataFrame, tag_col: str = "lang",
                         id_col: str = "doc_id") -> DataFrame:
    """A corpus-derived ``(term, tag)`` table: each term tagged with the
    document attribute (e.g. language) it occurs under most (ties: the
    larger tag)."""
    by = (counts.join(docs.select(id_col, tag_col), id_col)
          .groupBy("term", tag_col).agg(F.sum("n").alias("n")))
    return by.groupBy("term").agg(F.max_by(F.col(tag_col), F.struct("n", tag_col)).alias("tag"))


def fit_topic_model(docs: DataFrame, clusters: DataFrame, vectors: DataFrame, text_col: str = "text",
                    id_col: str = "doc_id", min_df=MIN_DF, max_df=MAX_DF, top_n: int = 10,
                    min_n: int = 1, max_n: int = 1, n_docs: int = 3,
                    aspects: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """G1–G7 + D13 composed: the tables of a saved topic model — the whole c-TF-IDF
    (from which a loaded model makes its hierarchy), words, vectors, documents, the
    topic table with ``n_docs`` representative documents, and the settings.
    ``aspects`` names functions from the other tables to further words per topic
    ``(topic, rank, term)``, such as a rerank or MMR."""
    from agora.operators.vectors import topic_vectors
    dt = assign_topics(clusters, "cluster", id_col)
    known = dt.where(F.col("topic") != NOISE)
    cc = prune_class_vocab(class_term_counts(docs, dt, text_col, id_col, min_n, max_n), min_df, max_df)
    scores = write_shared(ctfidf(cc), "ctfidf")  # read by the words and by the model
    model = {"ctfidf": scores, "topic_terms": topic_words(scores, top_n), "doc_topics": dt,
             "topic_vectors": topic_vectors(vectors, dt, id_col)}
    model["topic_info"] = topic_info(
        known, model["topic_terms"], aspects={n: f(model) for n, f in (aspects or {}).items()},
        representatives=representative_docs(vectors, known, model["topic_vectors"], n_docs, id_col), id_col=id_col)
    settings = {"min_df": min_df, "max_df": max_df, "top_n": top_n, "min_n": min_n, "max_n": max_n, "n_docs": n_docs,
                "aspects": list(aspects or {})}
    model["settings"] = docs.sparkSession.createDataFrame(
        [(k, json.dumps(v)) for k, v in settings.items()], "name string, value string")
    return model


def model_settings(model: dict[str, DataFrame]) -> dict:
    """The settings that a model was fitted with."""
    return {r["name"]: json.loads(r["value"]) for r in model["settings"].collect()}
