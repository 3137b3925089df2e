"""What the text path shuffles, and what it must not."""
import re

import numpy as np
from pyspark.sql import functions as F

from agora.operators import embed, joins, knn, terms
from agora.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\w+\([^)]*\)|\w+)", plan)


def test_a_documents_terms_and_vector_stay_in_its_row(spark):
    docs = fx.docs(spark, SF)
    assert exchanges(terms.count_terms(docs, keep=("source",))) == []
    assert exchanges(terms.corpus_tfidf(docs)) == []
    assert exchanges(embed.embed_text(docs)) == []


def test_cluster_terms_shuffle_only_sums(spark):
    docs = fx.docs(spark, SF).withColumn("cluster", fx.source_cluster())
    found = exchanges(terms.cluster_top_terms(docs, fx.source_clusters(spark, SF)))
    assert found and not any("doc_id" in x or "RoundRobin" in x for x in found)


def test_scan_reads_the_needed_columns_only(spark):
    plan = terms.count_terms(fx.docs(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def test_counts_by_hand(spark):
    docs = spark.createDataFrame([(1, "Apple apple pear"), (2, None), (3, ""), (4, "the and pear")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["n"] for r in terms.count_terms(docs).collect()}
    assert got == {(1, "apple"): 2, (1, "pear"): 1, (4, "pear"): 1}
    got = {(r["doc_id"], r["term"]): r["n"] for r in terms.count_terms(docs, min_n=1, max_n=3).collect()}
    assert got == {(1, "apple"): 2, (1, "pear"): 1, (1, "apple apple"): 1, (1, "apple pear"): 1, (1, "apple apple pear"): 1,
                   (4, "pear"): 1}


def test_similarity_join_meets_every_pair_once(spark):
    rng = np.random.default_rng(0)
    left = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(70)], "a long, x array<double>")
    right = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(9)] + [(9, [0.0, 0.0, 0.0])],
                                  "b long, y array<double>")
    out = joins.similarity_join(left, right, "x", "y")
    assert out.count() == 700 and out.select("a", "b").distinct().count() == 700
    assert out.filter("b = 9 and similarity <> 0").count() == 0


def test_knn_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(12)] + [(i, [0.0, 1.0]) for i in range(12, 15)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    got = {}
    for r in knn.knn_exact(df, 3, block_rows=4).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got[0] == [1, 2, 3] and got[5] == [0, 1, 2] and got[12][:2] == [13, 14]
    assert all(len(v) == 3 for v in got.values()) and not any(k in v for k, v in got.items())


def test_similarity_join_shuffles_nothing_for_a_stated_table(spark):
    left = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "a long, x array<double>")
    right = spark.createDataFrame([(1, [1.0, 0.0])], "b long, y array<double>")
    assert exchanges(joins.similarity_join(left, right, "x", "y", 0.5)) == []


def test_similarity_join_with_many_right_rows_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    odd = [None, [], [0.0, 0.0], [1.0], [1.0, 2.0, 3.0]]
    side = lambda n: [(i, rng.normal(size=2).tolist()) for i in range(n)] + [(n + i, v) for i, v in enumerate(odd)]
    left, right = side(40), side(30)
    x = spark.createDataFrame(left, "a long, x array<double>")
    y = spark.createDataFrame(right, "b long, y array<double>")

    def cosine(u, v):
        if not u or not v or len(u) != len(v) or not any(u) or not any(v):
            return 0.0
        return float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))

    want = {(i, j): cosine(u, v) for i, u in left for j, v in right}
    for block in (4096, 7):
        monkeypatch.setattr(joins, "RIGHT_BLOCK", block)
        monkeypatch.setattr(joins, "LEFT_BLOCK", 9)
        for bound in (None, 0.3):
            got = {(r["a"], r["b"]): r["similarity"] for r in joins.similarity_join(x, y, "x", "y", bound).collect()}
            kept = {k: v for k, v in want.items() if bound is None or v > bound}
            assert got.keys() == kept.keys() and all(abs(got[k] - kept[k]) < 1e-9 for k in kept)


def test_topic_counts_shuffle_no_text(spark):
    from agora.operators import topics
    from agora.plans import model as M
    mapping = M.topic_mapping(spark, SF)
    groups = M.groups(spark)
    labels = topics.assign_topics(fx.source_clusters(spark, SF))
    for docs, table in [(M.clustered_corpus(spark, SF), mapping), (M.corpus(spark, SF), labels)]:
        for df in (topics.class_term_counts(docs, table), terms.group_top_bigrams(docs, table, groups)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            above = plan[:plan.index("MapInArrow")]  # what comes after the counting inside rows
            assert "text#" not in above and "Exchange" in above
            below = plan[plan.index("MapInArrow"):]
            assert not re.search(r"Exchange hashpartitioning\((doc_id|cluster)[^\n]*\n[^\n]*text#", below)


def test_topics_by_cluster_or_by_id(spark):
    from agora.operators import topics
    docs = spark.createDataFrame([(1, "wind wind sun", 5), (2, "sun coal", 7), (3, "sun", 5), (4, "coal", -1), (5, None, 7)],
                                 "doc_id long, text string, cluster int")
    mapping = topics.topic_mapping(docs)
    want = {(0, "wind"): 2, (0, "sun"): 2, (1, "sun"): 1, (1, "coal"): 1}
    for table in (mapping, topics.assign_topics(docs)):
        got = {(r["topic"], r["term"]): r["n"] for r in topics.class_term_counts(docs, table).collect()}
        assert got == want


def test_sentiment_by_hand(spark):
    from agora.operators import sentiment
    chunks = spark.createDataFrame([(1, "good GOOD bad"), (2, "the fear"), (3, ""), (4, None)], "doc_id long, chunk string")
    got = {r["doc_id"]: (r["score"], r["sentiment"]) for r in sentiment.lexicon_sentiment(chunks).collect()}
    assert got == {1: (1, "Positive"), 2: (-1, "Negative"), 3: (0, "Neutral"), 4: (None, "Neutral")}
