"""Topic search, categories and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.constants import CATEGORY_THRESHOLD, OTHER_CATEGORY
from agora.operators.joins import similarity_join
from agora.operators.terms import top_n_per_group


def search_topics(queries: DataFrame, topic_vecs: DataFrame, top_n: int = 10,
                  words: DataFrame | None = None, query_key: str = "query_id") -> DataFrame:
    """H1: per query, the ``top_n`` topics by cosine(query, topic vector)
    → ``(query_key, rank, topic, similarity[, words])``. The query table is
    size-checked and broadcast; topics stream."""
    q = queries.select(query_key, F.col("embedding").alias("qv"))
    t = topic_vecs.select("topic", F.col("embedding").alias("tv"))
    s = similarity_join(t, q, "tv", "qv")
    r = top_n_per_group(s.select(query_key, "topic", "similarity"), query_key, "similarity",
                        top_n, tie_cols=("topic",))
    out = r.select(query_key, "rank", "topic", "similarity")
    if words is not None:
        out = out.join(topic_word_list(words), "topic", "left")
    return out


def topic_word_list(words: DataFrame) -> DataFrame:
    """``(topic, words)`` — a topic's words, best first, joined by ', '."""
    return (words.groupBy("topic")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_rt"))
            .select("topic", F.array_join(F.transform("_rt", lambda s: s["term"]), ", ").alias("words")))


def search_topics_many(queries: DataFrame, topic_vecs: DataFrame, top_n: int = 10,
                       words: DataFrame | None = None, query_key: str = "query_id") -> DataFrame:
    """H2: union of every query's top-n topics, de-duplicated."""
    t = search_topics(queries, topic_vecs, top_n, None, query_key).select("topic").distinct()
    return t.join(topic_word_list(words), "topic", "left") if words is not None else t


def category_topics(categories: DataFrame, topic_vecs: DataFrame,
                    threshold: float = CATEGORY_THRESHOLD) -> DataFrame:
    """H3: per category, all topics with similarity strictly above the
    threshold, ranked by similarity → ``(category, rank, topic, similarity)``."""
    q = categories.select("category", F.col("embedding").alias("qv"))
    t = topic_vecs.select("topic", F.col("embedding").alias("tv"))
    s = similarity_join(t, q, "tv", "qv", threshold=threshold)
    w = Window.partitionBy("category").orderBy(F.desc(F.round("similarity", 9)), F.asc("topic"))
    return s.select("category", "topic", "similarity").withColumn("rank", F.row_number().over(w)) \
        .select("category", "rank", "topic", "similarity")


def category_membership(doc_topics: DataFrame, cat_topics: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """H4: ``(doc_id, category)`` for every category one of whose topics is
    the document's topic (long form; zeros implicit). The category-topic
    table holds at most categories × topics rows."""
    return (doc_topics.select(id_col, "topic")
            .join(cat_topics.select("category", "topic").distinct(), "topic")
            .select(id_col, "category"))


def overlap_weights(membership: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """H5: weight 1 / (number of categories the document is in)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    return membership.select(id_col, "category", (F.lit(1.0) / n).alias("weight"))


def category_proportions(weights: DataFrame, categories: DataFrame, doc_topics: DataFrame | None = None,
                         mode: str = "relative", other: str = OTHER_CATEGORY) -> DataFrame:
    """H6: ``(category, proportion)`` in percent, every category listed,
    plus ``other`` = 100 − Σ.

    ``relative`` (the reference's arithmetic): divide by the total assigned
    weight, so Other is ~0; a zero total gives NULL. ``all_docs``: divide
    by the number of documents, so Other is the uncategorised share."""
    sums = weights.groupBy("category").agg(F.sum("weight").alias("w"))
    cats = categories.select("category").distinct()
    per = cats.join(sums, "category", "left").select("category", F.coalesce("w", F.lit(0.0)).alias("w"))
    if mode == "all_docs":
        if doc_topics is None:
            raise ValueError("all_docs mode needs doc_topics")
        total = doc_topics.select(F.count(F.lit(1)).cast("double")).scalar()
    else:
        # total of the per-category sums: a window over the (categories-row)
        # table instead of a second pass over the weights
        total = F.sum("w").over(Window.partitionBy())
    prop = F.when(total > 0, F.col("w") / total * 100.0)
    body = per.select("category", prop.alias("proportion"))
    rest = body.agg((F.lit(100.0) - F.sum("proportion")).alias("proportion")) \
        .select(F.lit(other).alias("category"), "proportion")
    return body.unionByName(rest)


def keyword_similarity(doc_vecs: DataFrame, keyword_vecs: DataFrame, id_col: str = "doc_id",
                       as_map: bool = False) -> DataFrame:
    """H7: every document against every (distinct) keyword; 0 when a vector
    is missing or zero. Long form ``(doc_id, keyword, similarity)`` or one
    map per document."""
    kw = keyword_vecs.select("keyword", F.col("embedding").alias("kv")).dropDuplicates(["keyword"])
    d = doc_vecs.select(id_col, F.col("embedding").alias("dv"))
    s = similarity_join(d, kw, "dv", "kv").select(id_col, "keyword", "similarity")
    if not as_map:
        return s
    return s.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("keyword", "similarity")))).alias("similarity_scores"))


def group_rollup(doc_topics: DataFrame, groups: DataFrame, group_bigrams: DataFrame,
                 amplification: float = 2.0) -> DataFrame:
    """H8: chart table ``(label, parent, value)``: a row per group (value =
    documents in its topics; a topic in several groups counts in each) and
    one per top bigram of the group (value = count × amplification)."""
    g = groups.select("group", "topic")
    group_rows = (doc_topics.select("topic").join(g, "topic").groupBy("group")
                  .agg(F.count(F.lit(1)).cast("double").alias("value"))
                  .select(F.col("group").alias("label"), F.lit("").alias("parent"), "value"))
    child_rows = group_bigrams.select(F.col("bigram").alias("label"), F.col("group").alias("parent"),
                                      (F.col("count") * amplification).alias("value"))
    return group_rows.unionByName(child_rows)


def group_subthemes(words: DataFrame, groups: DataFrame, amplification: float = 2.0) -> DataFrame:
    """H9: per group, each topic word's weights summed over the group's
    topics × amplification, descending → ``(group, rank, term, value)``."""
    g = groups.select("group", "topic")
    s = (words.join(g, "topic").groupBy("group", "term")
         .agg((F.sum("score") * amplification).alias("value")))
    w = Window.partitionBy("group").orderBy(F.desc(F.round("value", 9)), F.asc("term"))
    return s.withColumn("rank", F.row_number().over(w)).select("group", "rank", "term", "value")


def topic_keyword_pool(words: DataFrame, topics: DataFrame, top_n: int = 500) -> DataFrame:
    """Words of the selected topics, the best ``top_n`` (word, weight)
    entries overall, one weight per word (the smallest of its entries)."""
    sel = words.join(topics.select("topic").distinct(), "topic", "left_semi")
    best = sel.orderBy(F.desc(F.round("score", 9)), F.asc("term"), F.asc("topic")).limit(top_n)
    return best.groupBy("term").agg(F.min("score").alias("weight"))


def topic_rollup(doc_topics: DataFrame, words: DataFrame, topics: DataFrame,
                 doc_weight: float = 0.1, top_words: int = 10) -> DataFrame:
    """``(label, parent, value)``: per selected topic a row
    ``Topic {id}`` with value doc_weight × documents, and its first
    ``top_words`` words with their weights."""
    sel = topics.select("topic").distinct()
    label = F.concat(F.lit("Topic "), F.col("topic").cast("string"))
    tops = (doc_topics.select("topic").join(sel, "topic").groupBy("topic")
            .agg((F.count(F.lit(1)) * doc_weight).alias("value"))
            .select(label.alias("label"), F.lit("").alias("parent"), "value"))
    kids = (words.where(F.col("rank") <= top_words).join(sel, "topic")
            .select(F.col("term").alias("label"), label.alias("parent"), F.col("score").alias("value")))
    return tops.unionByName(kids)


def embed_queries(spark_df: DataFrame, text_col: str = "query", key: str = "category", embedder=None,
                  dim: int = 64) -> DataFrame:
    """Query vectors with the same embedder as the documents."""
    from agora.operators.embed import embed_column
    return embed_column(spark_df, text_col, embedder, dim=dim)
