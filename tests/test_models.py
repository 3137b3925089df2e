"""User models plugged into embedding and sentiment."""
import os

import numpy as np
from pyspark.sql import functions as F

from agora.operators import embed, search, sentiment, topics


def models():
    """Functions of their own, so that workers needn't import this file."""
    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    def make_model():
        made = int(os.environ.get("AGORA_TEST_MADE", "0")) + 1  # in this worker process
        os.environ["AGORA_TEST_MADE"] = str(made)
        return lambda texts: np.array([[1.0, made - 1.0] for _ in texts])
    return lengths, make_model


lengths, make_model = models()


def test_model_embed_keeps_the_key_type_and_cuts_texts(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", None), ("c", "x")], "k string, text string")
    got = {r["k"]: r["embedding"] for r in embed.embed_text(df, "text", "k", lengths, max_tokens=2).collect()}
    assert set(got) == {"a", "c"}
    assert np.allclose(got["a"], np.array([7, 1]) / np.sqrt(50), atol=1e-6)


def test_factory_makes_one_model_per_worker(spark):
    df = spark.range(40).withColumn("text", F.lit("t")).repartition(8)
    rows = embed.model_embed(df, make_model, "text", "id", factory=True).collect()
    assert len(rows) == 40 and all(np.allclose(r["embedding"], [1.0, 0.0]) for r in rows)


def test_embed_queries_with_a_model(spark):
    cats = spark.createDataFrame([("health", "long query"), ("law", "q")], "category string, query string")
    out = search.embed_queries(cats, "query", "category", embedder=lengths)
    assert {r["category"] for r in out.collect()} == {"health", "law"}


def test_embed_column_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "c", "y"), (2, None, "z")], "doc_id long, text string, note string")
    for model in (None, lengths):
        rows = embed.embed_column(df, embedder=model).collect()
        assert sorted((r["doc_id"], r["text"], r["note"]) for r in rows) == [(1, "a b", "x"), (1, "c", "y")]


def test_model_sentiment(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "good"), (3, "so")], "id long, chunk string")

    def scorer(texts):
        return np.array([[t == "bad", t == "so", t == "good"] for t in texts], float)
    got = {r["id"]: r["sentiment"].lower() for r in sentiment.model_sentiment(df, scorer, "chunk").collect()}
    assert got == {1: "negative", 2: "positive", 3: "neutral"}


def test_fit_topic_model(spark):
    docs = spark.createDataFrame([(i, "apple pear apple" if i % 2 else "train bus rail") for i in range(8)],
                                 "doc_id long, text string")
    clusters = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, cluster int")
    vectors = embed.embed_text(docs)
    model = topics.fit_topic_model(docs, clusters, vectors, min_df=1, max_df=1.0)
    words = {(r["topic"], r["term"]) for r in model["topic_terms"].collect()}
    assert {t for _, t in words} == {"apple", "pear", "train", "bus", "rail"} and model["topic_vectors"].count() == 2


def test_saved_model_is_whole(spark):
    """Settings, aspects, representative documents, and a hierarchy from the loaded
    model that equals the fresh one's."""
    import tempfile
    from agora.operators import hierarchy
    from agora.sources import io
    texts = ["apple pear fruit", "train rail fruit", "coal gas apple"]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(13)] + [(13, None)], "doc_id long, text string")
    clusters = spark.createDataFrame([(i, i % 3 if i < 12 else -1) for i in range(14)], "doc_id long, cluster int")
    vectors = embed.embed_text(docs)
    model = topics.fit_topic_model(docs, clusters, vectors, min_df=1, max_df=1.0, top_n=2, n_docs=2, aspects={
        "last": lambda m: m["topic_terms"].withColumn("rank", -m["topic_terms"]["rank"])})
    path = tempfile.mkdtemp(prefix="agora-model-")
    io.save_topic_model(model, path)
    back = io.load_topic_model(spark, path)
    assert topics.model_settings(back) == {"min_df": 1, "max_df": 1.0, "top_n": 2, "min_n": 1, "max_n": 1, "n_docs": 2,
                                           "aspects": ["last"]}
    info = {r["topic"]: r for r in back["topic_info"].collect()}
    assert set(info) == {0, 1, 2}
    for r in info.values():
        words = r["representation"].split(", ")
        assert r["aspect_last"].split(", ") == words[::-1] and len(words) == 2
        assert r["count"] == 4 and len(r["representative_docs"]) == 2
        assert len({i % 3 for i in r["representative_docs"]}) == 1
    tree = [hierarchy.ward_hierarchy(hierarchy.topic_distance(m["ctfidf"])).orderBy("step").collect() for m in (model, back)]
    assert len(tree[0]) == 2 and [r["topics"] for r in tree[0]] == [r["topics"] for r in tree[1]]


def test_topic_info_without_words_or_documents(spark):
    dt = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, topic int")
    words = spark.createDataFrame([(0, 1, "a")], "topic int, rank int, term string")
    near = spark.createDataFrame([(0, 1, 1)], "topic int, rank int, doc_id long")
    got = {r["topic"]: tuple(r) for r in topics.topic_info(dt, words, aspects={"x": words}, representatives=near).collect()}
    assert got == {0: (0, 1, "0_a", "a", "a", [1]), 1: (1, 1, "1_", "", "", [])}
