"""Term statistics: counts, vocabulary, TF-IDF, per-cluster top terms.

Data stay in long format ``(doc_id, term, n)``; nothing is densified. A
document's terms are counted, weighted and normalised inside its row (Arrow
batches of the JVM's tokens), so the first shuffle is the one on (cluster, term)
or (topic, term), after map-side sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.constants import ENGLISH_STOP_WORDS, MAX_FEATURES, NOISE, TOP_BIGRAMS, TOP_TERMS
from agora.functions.text import remove_stop_words, tokenize

# Scores are ranked at this many decimals, ties broken by the term, so the
# order does not depend on floating-point summation order.
RANK_DIGITS = 9


#: Documents whose terms are held at once.
_ROWS = 2048
#: Rows of a table of clusters and groups that is sent to all tasks.
SENT_TOPICS = 4096


def _tokens(docs: DataFrame, text_col: str, stop_words, keep: list[str]) -> DataFrame:
    toks = tokenize(F.col(text_col))
    return docs.select(*keep, (remove_stop_words(toks, stop_words) if stop_words else toks).alias("terms"))


def _grams(lists: pa.Array, min_n: int, max_n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row numbers and codes of all n-grams of a batch of token lists, and the
    distinct n-grams by code. Strings are made for distinct n-grams only."""
    row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    token = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    k = max(1, len(words.dictionary))
    rows, codes, names, first = [], [], [], 0
    at, code, name = np.arange(len(token)), token, words.dictionary
    for n in range(1, max_n + 1):
        if n > 1:  # those that have a next word in their row
            go = at + n - 1 < len(token)
            at, code = at[go], code[go]
            go = row[at] == row[at + n - 1]
            at, code = at[go], code[go]
            both, code = np.unique(code * k + token[at + n - 1], return_inverse=True)
            name = pc.binary_join_element_wise(
                name.take(pa.array(both // k)), words.dictionary.take(pa.array(both % k)), " ")
        if n >= min_n:
            rows.append(row[at])
            codes.append(code + first)
            names.append(name)
            first += len(name)
    return np.concatenate(rows), np.concatenate(codes), pa.concat_arrays(names)


def _in_rows(t: DataFrame, keep: list[str], min_n: int, max_n: int, work, out: str) -> DataFrame:
    """Run ``work(batch, rows, codes, terms)`` on Arrow batches of ``(*keep, terms)``.
    It returns places in the batch, term codes and values: the rows to come out.
    No shuffle: a document's terms are all in its own row."""
    types = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                rows, codes, terms = _grams(b.column("terms").fill_null([]), min_n, max_n)
                row, code, value = work(b, rows, codes, terms)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(at) for c in keep], terms.take(pa.array(code)), pa.array(value)],
                    names=[*keep, "term", out])

    kind = "bigint" if out == "n" else "double"
    return t.select(*keep, "terms").mapInArrow(run, f"{types}, term string, {out} {kind}")


def _counted(group: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, code) pairs and how often each occurs."""
    both, n = np.unique(group * max(width, 1) + codes, return_counts=True)
    return both // max(width, 1), both % max(width, 1), n


def count_terms(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                min_n: int = 1, max_n: int = 1, stop_words=ENGLISH_STOP_WORDS,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, term, n)`` — one row per distinct term per document
    (row of ``docs``), counted inside the row."""
    cols = [id_col, *keep]
    return _in_rows(_tokens(docs, text_col, stop_words, cols), cols, min_n, max_n,
                    lambda b, rows, codes, terms: _counted(rows, codes, len(terms)), "n")


def batch_group_terms(docs: DataFrame, group_col: str, text_col: str = "text", min_n: int = 1, max_n: int = 1,
                      stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(group, term, n)`` of each batch of documents: what its groups hold of each
    term. No shuffle; a hot group has one row per term and batch."""
    def count(b, rows, codes, terms):
        of = b.column(group_col).dictionary_encode()
        number = of.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group, code, n = _counted(number[rows], codes, len(terms))
        _, example = np.unique(number, return_index=True)  # a row of each group
        return example[group], code, n

    t = _tokens(docs.filter(F.col(group_col).isNotNull()), text_col, stop_words, [group_col])
    return _in_rows(t, [group_col], min_n, max_n, count, "n")


def count_group_terms(docs: DataFrame, group_col: str, text_col: str = "text", min_n: int = 1, max_n: int = 1,
                      stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(group, term, n)``: terms of all documents of a group, counted per batch first."""
    return batch_group_terms(docs, group_col, text_col, min_n, max_n, stop_words).groupBy(group_col, "term").agg(
        F.sum("n").alias("n"))


def count_topic_terms(docs: DataFrame, topics: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      min_n: int = 1, max_n: int = 1, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(topic, term, n)``: terms of all documents of a topic, noise excluded.

    ``topics`` is ``(cluster, topic)`` for documents that hold their ``cluster``:
    terms are counted per cluster, and the mapping, a row per cluster, is joined to
    the counts. Or it is ``(id, topic)``: a document's counts are joined by id.
    Texts are not shuffled in either case."""
    known = topics.where(F.col("topic") != NOISE)
    if id_col in topics.columns:
        counts = count_terms(docs, text_col, id_col, min_n, max_n, stop_words)
        return counts.join(known.select(id_col, "topic"), id_col).groupBy("topic", "term").agg(F.sum("n").alias("n"))
    counts = count_group_terms(docs.where(F.col("cluster") != NOISE), "cluster", text_col, min_n, max_n, stop_words)
    return counts.join(known.select("cluster", "topic"), "cluster").groupBy("topic", "term").agg(F.sum("n").alias("n"))


def term_stats(counts: DataFrame, unit_col: str = "doc_id") -> DataFrame:
    """Per term: corpus count ``total`` and unit frequency ``df`` (``counts``
    holds one row per unit and term)."""
    return counts.groupBy("term").agg(F.sum("n").alias("total"),
                                      F.count(F.lit(1)).alias("df"))


def prune_vocab(stats: DataFrame, n_units, min_df=1, max_df=1.0) -> DataFrame:
    """keep terms with min_df ≤ df ≤ max_df. Integers are absolute unit
    counts, floats fractions of ``n_units`` (a number or a scalar Column)."""
    n = n_units if hasattr(n_units, "cast") else F.lit(n_units)
    lo = F.lit(min_df) if isinstance(min_df, int) else F.lit(float(min_df)) * n
    hi = F.lit(max_df) if isinstance(max_df, int) else F.lit(float(max_df)) * n
    return stats.where((F.col("df") >= lo) & (F.col("df") <= hi))


def top_vocab(stats: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """the ``max_features`` terms with the highest corpus count (ties by
    term). ``orderBy().limit()`` plans as TakeOrderedAndProject: per-partition
    top-k, then one merge of k·partitions rows — no global sort."""
    return stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)


def corpus_tfidf(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 min_n: int = 1, max_n: int = 1, max_features: int = MAX_FEATURES,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, term, tfidf)`` over the top ``max_features`` terms;
    N counts every document, including ones with no terms.

    Passes over the text: :func:`agora.operators.tally.frequent` finds and counts
    the frequent terms; the last weights, prunes and normalises each document inside
    its row. The vocabulary between them has at most ``max_features`` rows."""
    from agora.operators import tally
    n_docs = docs.count()
    tokens = _tokens(docs.withColumn("_all", F.lit("")), text_col, ENGLISH_STOP_WORDS, ["_all"])
    counts = tally.frequent(tokens, "_all", max_features, min_n, max_n)
    vocab = top_vocab(counts.select("term", F.col("n").alias("total"), "df"), max_features).toArrow()
    known = vocab.column("term").combine_chunks()
    idf = np.log((1.0 + n_docs) / (vocab.column("df").to_numpy() + 1.0)) + 1.0

    def weigh(b, rows, codes, terms):
        row, code, n = _counted(rows, codes, len(terms))
        place = pc.index_in(terms, known).fill_null(-1).to_numpy(zero_copy_only=False)[code] if len(terms) else code
        row, code, n, place = (x[place >= 0] for x in (row, code, n, place))
        w = n * idf[place]
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))
        return row, code, w / norm[row]

    cols = [id_col, *keep]
    return _in_rows(_tokens(docs, text_col, ENGLISH_STOP_WORDS, cols), cols, min_n, max_n, weigh, "tfidf")


def cluster_mean_tfidf(weights: DataFrame, clusters: DataFrame, cluster_col: str = "cluster",
                       id_col: str = "doc_id") -> DataFrame:
    """F8: mean TF-IDF of each term over *all* documents of a cluster
    (documents without the term count as 0); noise (−1) skipped."""
    sizes = (clusters.where(F.col(cluster_col) != NOISE)
             .groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size")))
    sums = (weights.where(F.col(cluster_col) != NOISE)
            .groupBy(cluster_col, "term").agg(F.sum("tfidf").alias("s")))
    return sums.join(sizes, cluster_col).select(
        cluster_col, "term", (F.col("s") / F.col("size")).alias("score"))


def top_n_per_group(df: DataFrame, group_cols, score_col: str, n: int,
                    tie_cols=("term",), rank_col: str = "rank") -> DataFrame:
    """Top ``n`` rows per group by ``score`` (desc, rounded to RANK_DIGITS),
    ties by ``tie_cols``. ``row_number() <= n`` plans as a partial
    WindowGroupLimit before the exchange, so a hot group ships at most n
    rows per map partition."""
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    w = Window.partitionBy(*group_cols).orderBy(
        F.desc(F.round(F.col(score_col), RANK_DIGITS)), *[F.asc(c) for c in tie_cols])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def cluster_top_terms(docs: DataFrame, clusters: DataFrame, text_col: str = "text",
                      min_n: int = 1, max_n: int = 1, top_n: int = TOP_TERMS,
                      max_features: int = MAX_FEATURES, id_col: str = "doc_id") -> DataFrame:
    """``(cluster, rank, term, score)`` — the ``top_n`` terms with the
    highest mean TF-IDF per cluster; rank 1 is best. TF-IDF is fitted on
    every document, noise included.

    ``docs`` that hold their ``cluster`` need no join; otherwise the cluster is
    joined to the weights by id, the text is not shuffled."""
    if "cluster" in docs.columns:
        w = corpus_tfidf(docs, text_col, id_col, min_n, max_n, max_features, keep=("cluster",))
    else:
        w = corpus_tfidf(docs, text_col, id_col, min_n, max_n, max_features)
        w = w.join(clusters.select(id_col, "cluster"), id_col)
    means = cluster_mean_tfidf(w, clusters, "cluster", id_col)
    return top_n_per_group(means, "cluster", "score", top_n).select("cluster", "rank", "term", "score")


def group_top_bigrams(docs: DataFrame, topics: DataFrame, groups: DataFrame,
                      text_col: str = "text", id_col: str = "doc_id", top_n: int = TOP_BIGRAMS,
                      n: int = 2) -> DataFrame:
    """the ``top_n`` most frequent n-grams over all documents of each
    topic group ``(group, topic)``; ties alphabetical. A document whose topic
    is in several groups counts in each. ``topics`` as in :func:`count_topic_terms`.

    Where at most ``SENT_TOPICS`` rows tell which clusters belong to which groups,
    documents are given their groups where they are and only frequent n-grams are
    counted (:func:`agora.operators.tally.frequent`). Otherwise n-grams are counted
    per topic, map-side first, and groups are joined to those counts."""
    wanted = groups.select("topic").distinct()
    if id_col not in topics.columns:
        of = topics.where(F.col("topic") != NOISE).join(groups.select("group", "topic"), "topic").select("cluster", "group")
        rows, named = of.agg(F.count(F.lit(1)), F.count("group")).first()
        if rows == named <= SENT_TOPICS:
            from agora.operators import tally
            tokens = _tokens(docs.where(F.col("cluster") != NOISE), text_col, ENGLISH_STOP_WORDS, ["cluster"])
            counts = tally.frequent(tokens.join(F.broadcast(of), "cluster"), "group", top_n, n, n)
            return top_n_per_group(counts, "group", "n", top_n).select(
                "group", "rank", F.col("term").alias("bigram"), F.col("n").alias("count"))
    per_topic = count_topic_terms(docs, topics.join(wanted, "topic", "left_semi"), text_col, id_col, n, n)
    per_group = per_topic.join(groups.select("group", "topic"), "topic").groupBy("group", "term").agg(
        F.sum("n").alias("count"))
    return top_n_per_group(per_group, "group", "count", top_n).select(
        "group", "rank", F.col("term").alias("bigram"), "count")
