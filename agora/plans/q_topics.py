"""Registered queries: embedding, topic model, search, categories, roll-ups,
sentiment (D5, D13, F10–F13, G1–G10, H1–H11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions.constants import OTHER_CATEGORY
from agora.operators import heavy, search, sentiment, terms, topics, vectors, words
from agora.plans import model as M
from agora.plans.catalog import ORACLE, big, r6, register
from agora.plans.sqlfrag import tokens_expr

W = f"WITH {M.sql_model()}"


# Default embedder -------------------------------------------------
@register("embed_text", f"""{W}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM doc_vecs""")
def q_embed_text(spark, d):
    v = vectors.long_form(M.doc_vectors(spark, d))
    return v.where(F.col("value") != 0).select(big("doc_id").alias("doc_id"), big("dim").alias("dim"),
                                                 r6("value").alias("value"))


# G1 ----------------------------------------------------------------------
@register("assign_topics", f"""{W}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(topic AS BIGINT) AS topic FROM doc_topics""")
def q_assign_topics(spark, d):
    return M.doc_topics(spark, d).select(big("doc_id").alias("doc_id"), big("topic").alias("topic"))


# G2 ----------------------------------------------------------------------
@register("class_term_counts", f"""{W}
SELECT CAST(topic AS BIGINT) AS topic, term, CAST(n AS BIGINT) AS n FROM cc_raw""")
def q_class_term_counts(spark, d):
    return M.class_counts(spark, d).select(big("topic").alias("topic"), "term", big("n").alias("n"))


# F5 on topics ------------------------------------------------------------
# its SQL is flat: tokens, their clusters (as many as topics), counts of clusters
@register("prune_vocab", f"""
WITH toks AS MATERIALIZED (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS cluster,
    unnest({tokens_expr("text")}) AS term FROM documents),
per AS MATERIALIZED (SELECT DISTINCT cluster, term FROM toks WHERE cluster <> 0),
n AS (SELECT count(DISTINCT cluster) AS topics FROM per),
df AS (SELECT term, count(*) AS df FROM per GROUP BY term)
SELECT term, CAST(df AS BIGINT) AS df FROM df, n WHERE df >= {M.MIN_DF} AND df <= {M.MAX_DF} * topics""")
def q_prune_vocab(spark, d):
    pc = M.pruned_counts(spark, d)
    return terms.term_stats(pc, "topic").select("term", big("df").alias("df"))


# G3 ----------------------------------------------------------------------
@register("ctfidf", f"""{W}
SELECT CAST(topic AS BIGINT) AS topic, term, round(score, 6) AS score FROM ctfidf""")
def q_ctfidf(spark, d):
    return M.ctfidf(spark, d).select(big("topic").alias("topic"), "term", r6("score").alias("score"))


# G4 ----------------------------------------------------------------------
@register("topic_words", f"""{W}
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term, round(score, 6) AS score FROM words""")
def q_topic_words(spark, d):
    return M.words(spark, d).select(big("topic").alias("topic"), big("rank").alias("rank"), "term",
                                    r6("score").alias("score"))


_INFO_SQL = """info AS (
  SELECT t.topic, t.n AS count,
         CAST(t.topic AS VARCHAR) || '_' || coalesce(array_to_string(
             list(w.term ORDER BY w.rank) FILTER (WHERE w.rank <= 4), '_'), '') AS name,
         coalesce(array_to_string(list(w.term ORDER BY w.rank), ', '), '') AS representation
  FROM tsize t LEFT JOIN words w ON t.topic = w.topic GROUP BY t.topic, t.n)"""


# G5 ----------------------------------------------------------------------
@register("topic_info", f"""{W}, {_INFO_SQL}
SELECT CAST(topic AS BIGINT) AS topic, CAST(count AS BIGINT) AS count, name, representation FROM info""")
def q_topic_info(spark, d):
    dt = M.doc_topics(spark, d).where(F.col("topic") != -1)
    info = topics.topic_info(dt, M.words(spark, d))
    return info.select(big("topic").alias("topic"), big("count").alias("count"), "name", "representation")


# G6 ----------------------------------------------------------------------
@register("document_info", f"""{W}, {_INFO_SQL}
SELECT CAST(dt.doc_id AS BIGINT) AS doc_id, CAST(dt.topic AS BIGINT) AS topic, i.name, i.representation
FROM doc_topics dt LEFT JOIN info i ON dt.topic = i.topic""")
def q_document_info(spark, d):
    dt = M.doc_topics(spark, d)
    info = topics.topic_info(dt.where(F.col("topic") != -1), M.words(spark, d))
    return topics.document_info(dt, info).select(big("doc_id").alias("doc_id"), big("topic").alias("topic"),
                                                 "name", "representation")


# D13 ---------------------------------------------------------------------
@register("topic_vectors", f"""{W}
SELECT CAST(topic AS BIGINT) AS topic, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value
FROM topic_vecs WHERE round(value, 6) <> 0""")
def q_topic_vectors(spark, d):
    tv = vectors.long_form(M.topic_vecs(spark, d), "topic")
    return tv.where(F.round("value", 6) != 0).select(big("topic").alias("topic"), big("dim").alias("dim"),
                                                      r6("value").alias("value"))


# G7 ----------------------------------------------------------------------
@register("representative_docs", f"""{W},
dn AS (SELECT doc_id, sqrt(sum(value * value)) AS nrm FROM doc_vecs GROUP BY doc_id),
dot AS (SELECT t.topic, v.doc_id, sum(v.value * tv.value) AS d
        FROM doc_vecs v JOIN doc_topics t ON v.doc_id = t.doc_id
        JOIN topic_vecs tv ON tv.topic = t.topic AND tv.dim = v.dim GROUP BY t.topic, v.doc_id),
sim AS (SELECT t.topic, t.doc_id,
               CASE WHEN dn.nrm IS NULL OR dn.nrm = 0 OR tn.nrm = 0 THEN 0.0
                    ELSE coalesce(dot.d, 0) / (dn.nrm * tn.nrm) END AS similarity
        FROM doc_topics t JOIN tnorm tn ON t.topic = tn.topic
        LEFT JOIN dn ON dn.doc_id = t.doc_id LEFT JOIN dot ON dot.topic = t.topic AND dot.doc_id = t.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM sim)
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, CAST(doc_id AS BIGINT) AS doc_id,
       round(similarity, 6) AS similarity FROM r WHERE rank <= 3""")
def q_representative_docs(spark, d):
    r = topics.representative_docs(M.doc_vectors(spark, d), M.doc_topics(spark, d), M.topic_vecs(spark, d), 3)
    return r.select(big("topic").alias("topic"), big("rank").alias("rank"), big("doc_id").alias("doc_id"),
                    r6("similarity").alias("similarity"))


def _term_vec_sql() -> str:
    return """cterms AS (SELECT DISTINCT term FROM cand),
tv_long AS (SELECT c.term, v.dim, sum(c.n * v.value) / any_value(tot.n) AS value
            FROM counts c JOIN cterms USING (term) JOIN doc_vecs v ON v.doc_id = c.doc_id
            JOIN (SELECT term, sum(n) AS n FROM counts WHERE term IN (SELECT term FROM cterms) GROUP BY term) tot
              ON tot.term = c.term
            GROUP BY c.term, v.dim),
twn AS (SELECT term, sqrt(sum(value * value)) AS nrm FROM tv_long GROUP BY term),
wdot AS (SELECT c.topic, c.term, sum(w.value * t.value) AS d
         FROM cand c JOIN tv_long w ON w.term = c.term JOIN topic_vecs t ON t.topic = c.topic AND t.dim = w.dim
         GROUP BY c.topic, c.term),
wsim AS (SELECT c.topic, c.term,
                CASE WHEN twn.nrm IS NULL OR twn.nrm = 0 OR tn.nrm = 0 THEN 0.0
                     ELSE coalesce(wdot.d, 0) / (twn.nrm * tn.nrm) END AS score
         FROM cand c JOIN twn ON twn.term = c.term JOIN tnorm tn ON tn.topic = c.topic
         LEFT JOIN wdot ON wdot.topic = c.topic AND wdot.term = c.term)"""


def _rerank_inputs(spark, d):
    cand = M.words(spark, d, M.CANDIDATES)
    counts = terms.count_terms(M.corpus(spark, d))
    tv = topics.term_vectors(counts, M.doc_vectors(spark, d), cand)
    return cand, tv, M.topic_vecs(spark, d)


# G8 ----------------------------------------------------------------------
@register("rerank_by_embedding", f"""{W}, {_term_vec_sql()},
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM wsim)
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term, round(score, 6) AS score
FROM r WHERE rank <= 10""")
def q_rerank(spark, d):
    cand, tv, tvec = _rerank_inputs(spark, d)
    r = topics.rerank_by_embedding(cand, tv, tvec, 10)
    return r.select(big("topic").alias("topic"), big("rank").alias("rank"), "term", r6("score").alias("score"))


@register("topic_table", f"""
WITH near AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS words FROM ({ORACLE["rerank_by_embedding"]}) GROUP BY topic),
docs AS (SELECT topic, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS ids FROM ({ORACLE["representative_docs"]}) GROUP BY topic)
SELECT topic, count, name, coalesce(words, '') AS aspect_reranked, coalesce(ids, '') AS representative_docs
FROM ({ORACLE["topic_info"]}) LEFT JOIN near USING (topic) LEFT JOIN docs USING (topic)""")
def q_topic_table(spark, d):
    dt = M.doc_topics(spark, d).where(F.col("topic") != -1)
    cand, tv, tvec = _rerank_inputs(spark, d)
    info = topics.topic_info(
        dt, M.words(spark, d), aspects={"reranked": topics.rerank_by_embedding(cand, tv, tvec, 10)},
        representatives=topics.representative_docs(M.doc_vectors(spark, d), dt, M.topic_vecs(spark, d), 3))
    return info.select(big("topic").alias("topic"), big("count").alias("count"), "name", "aspect_reranked",
                       F.array_join(F.col("representative_docs").cast("array<string>"), " ").alias("representative_docs"))


# G9 (Python per topic over ≤ 30 candidates; pytest checks the greedy) ------
@register("mmr")
def q_mmr(spark, d):
    cand, tv, tvec = _rerank_inputs(spark, d)
    r = topics.mmr(cand, tv, tvec, 10, 0.8)
    return r.select(big("topic").alias("topic"), big("rank").alias("rank"), "term", r6("score").alias("score"))


# word vectors from co-occurrence: the 300 most frequent terms, windows of 5 --
VOCAB, WINDOW = 300, 5


def _word_pairs(spark, d):
    docs = M.corpus(spark, d).select("doc_id", "text")
    vocab = terms.top_vocab(terms.term_stats(terms.count_terms(docs)), VOCAB)
    return words.word_pairs(docs, vocab, "text", WINDOW)


@register("word_pairs", f"""
WITH t AS MATERIALIZED (SELECT doc_id, {tokens_expr("text")} AS toks FROM documents),
u AS MATERIALIZED (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM t),
vocab AS (SELECT term FROM u GROUP BY term ORDER BY count(*) DESC, term LIMIT {VOCAB}),
v AS MATERIALIZED (SELECT * FROM u WHERE term IN (SELECT term FROM vocab)),
pairs AS MATERIALIZED (SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS n
  FROM (SELECT *, unnest(range(1, {WINDOW + 1})) AS lag FROM v) x JOIN v y ON y.doc_id = x.doc_id AND y.pos = x.pos + x.lag
  GROUP BY ALL),
ways AS (SELECT a, b, CASE WHEN a = b THEN 2 * n ELSE n END AS n FROM pairs UNION ALL SELECT b, a, n FROM pairs WHERE a <> b),
w AS MATERIALIZED (SELECT a AS term, CAST(sum(n) AS DOUBLE) AS n FROM ways GROUP BY a)
SELECT p.a, p.b, CAST(p.n AS BIGINT) AS n, round(greatest(0.0, ln(CASE WHEN p.a = p.b THEN 2 ELSE 1 END * p.n *
  (SELECT sum(n) FROM w) / (wa.n * wb.n))), 6) AS information
FROM pairs p JOIN w wa ON wa.term = p.a JOIN w wb ON wb.term = p.b""")
def q_word_pairs(spark, d):
    return words.positive_information(_word_pairs(spark, d)).select("a", "b", big("n").alias("n"),
                                                                   r6("information").alias("information"))


@register("rerank_by_words")
def q_rerank_by_words(spark, d):
    cand = M.words(spark, d, M.CANDIDATES)
    docs = M.corpus(spark, d).select("doc_id", "text")
    vecs = words.word_vectors(words.word_pairs(docs, cand, "text", WINDOW), 16)
    r = topics.rerank_by_embedding(cand, vecs, words.word_topic_vectors(M.words(spark, d), vecs), 10)
    return r.select(big("topic").alias("topic"), big("rank").alias("rank"), "term", r6("score").alias("score"))


# G10 ---------------------------------------------------------------------
@register("lexicon_filter", f"""{W},
bylang AS (SELECT c.term, d.lang, sum(c.n) AS n FROM counts c JOIN corpus d ON c.doc_id = d.doc_id
           WHERE c.term IN (SELECT term FROM cand) GROUP BY c.term, d.lang),
lex AS (SELECT term, arg_max(lang, (n, lang)) AS tag FROM bylang GROUP BY term)
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term
FROM cand WHERE term IN (SELECT term FROM lex WHERE tag = 'en')""")
def q_lexicon_filter(spark, d):
    cand = M.words(spark, d, M.CANDIDATES)
    counts = terms.count_terms(M.corpus(spark, d)).join(cand.select("term").distinct(), "term", "left_semi")
    lex = topics.majority_tag_lexicon(M.corpus(spark, d), counts, "lang")
    return topics.lexicon_filter(cand, lex, ["en"]).select(big("topic").alias("topic"),
                                                           big("rank").alias("rank"), "term")


# H1 / H2 -----------------------------------------------------------------
_BENCH_VEC = M.sql_hash_embed("qvec", "benchmark", "item_id", "text")


def _qsim_sql() -> str:
    return f"""{_BENCH_VEC}, {M.sql_cosine_long('qvec', 'item_id', 'topic_vecs', 'topic', 'qsim')},
qr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, topic) AS rank
       FROM qsim)"""


@register("search_topics", f"""{W}, {_qsim_sql()},
wl AS (SELECT topic, array_to_string(list(term ORDER BY rank), ', ') AS words FROM words GROUP BY topic)
SELECT CAST(item_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, CAST(qr.topic AS BIGINT) AS topic,
       round(similarity, 6) AS similarity, wl.words
FROM qr LEFT JOIN wl ON wl.topic = qr.topic WHERE rank <= 10""")
def q_search_topics(spark, d):
    r = search.search_topics(M.benchmark_vecs(spark, d), M.topic_vecs(spark, d), 10, M.words(spark, d))
    return r.select(big("query_id").alias("query_id"), big("rank").alias("rank"), big("topic").alias("topic"),
                    r6("similarity").alias("similarity"), "words")


@register("search_topics_many", f"""{W}, {_qsim_sql()}
SELECT DISTINCT CAST(topic AS BIGINT) AS topic FROM qr WHERE rank <= 3""")
def q_search_many(spark, d):
    r = search.search_topics_many(M.benchmark_vecs(spark, d), M.topic_vecs(spark, d), 3)
    return r.select(big("topic").alias("topic"))


# C4 / C5 / H3–H6 ----------------------------------------------------------
_CAT_VEC = f"{M.sql_categories()}, " + M.sql_hash_embed("cvec", "categories", "category", "query")


def _catsim_sql() -> str:
    return f"""{_CAT_VEC}, {M.sql_cosine_long('cvec', 'category', 'topic_vecs', 'topic', 'csim')}"""


@register("query_topic_similarity", f"""{W}, {_catsim_sql()}
SELECT category, CAST(topic AS BIGINT) AS topic, round(similarity, 6) AS similarity FROM csim""")
def q_query_topic_similarity(spark, d):
    from agora.operators.joins import similarity_join
    t = M.topic_vecs(spark, d).select("topic", F.col("embedding").alias("tv"))
    q = M.category_vecs(spark).select("category", F.col("embedding").alias("qv"))
    s = similarity_join(t, q, "tv", "qv")
    return s.select("category", big("topic").alias("topic"), r6("similarity").alias("similarity"))


_CT = M.CATEGORY_THRESHOLD_FIXTURE


def _cat_topics_sql() -> str:
    return f"""{_catsim_sql()},
ct AS (SELECT category, topic, similarity,
              row_number() OVER (PARTITION BY category ORDER BY round(similarity, 9) DESC, topic) AS rank
       FROM csim WHERE similarity > {_CT})"""


def _cat_topics(spark, d):
    return search.category_topics(M.category_vecs(spark), M.topic_vecs(spark, d), _CT)


@register("category_theta_join", f"""{W}, {_cat_topics_sql()}
SELECT category, CAST(topic AS BIGINT) AS topic FROM ct""")
def q_theta(spark, d):
    return _cat_topics(spark, d).select("category", big("topic").alias("topic"))


@register("category_topics", f"""{W}, {_cat_topics_sql()}
SELECT category, CAST(rank AS BIGINT) AS rank, CAST(topic AS BIGINT) AS topic, round(similarity, 6) AS similarity
FROM ct""")
def q_category_topics(spark, d):
    return _cat_topics(spark, d).select("category", big("rank").alias("rank"), big("topic").alias("topic"),
                                        r6("similarity").alias("similarity"))


_MEMB = """memb AS (SELECT DISTINCT dt.doc_id, ct.category FROM doc_topics dt JOIN ct ON ct.topic = dt.topic),
wts AS (SELECT doc_id, category, 1.0 / count(*) OVER (PARTITION BY doc_id) AS weight FROM memb)"""


def _weights(spark, d):
    memb = search.category_membership(M.doc_topics(spark, d), _cat_topics(spark, d))
    return search.overlap_weights(memb)


@register("category_membership", f"""{W}, {_cat_topics_sql()}, {_MEMB}
SELECT CAST(doc_id AS BIGINT) AS doc_id, category FROM memb""")
def q_membership(spark, d):
    m = search.category_membership(M.doc_topics(spark, d), _cat_topics(spark, d))
    return m.select(big("doc_id").alias("doc_id"), "category")


@register("overlap_weights", f"""{W}, {_cat_topics_sql()}, {_MEMB}
SELECT CAST(doc_id AS BIGINT) AS doc_id, category, round(weight, 6) AS weight FROM wts""")
def q_overlap(spark, d):
    return _weights(spark, d).select(big("doc_id").alias("doc_id"), "category", r6("weight").alias("weight"))


def _props_sql(denominator: str) -> str:
    return f"""{W}, {_cat_topics_sql()}, {_MEMB},
per AS (SELECT c.category, coalesce(sum(w.weight), 0.0) AS w
        FROM categories c LEFT JOIN wts w ON w.category = c.category GROUP BY c.category),
tot AS (SELECT {denominator} AS t),
body AS (SELECT category, CASE WHEN (SELECT t FROM tot) > 0 THEN w / (SELECT t FROM tot) * 100.0 END AS proportion
         FROM per)
SELECT category, round(proportion, 6) AS proportion FROM body
UNION ALL SELECT '{OTHER_CATEGORY}', round(100.0 - sum(proportion), 6) FROM body"""


@register("category_proportions", _props_sql("(SELECT sum(weight) FROM wts)"))
def q_props(spark, d):
    cats = M.category_vecs(spark).select("category")
    p = search.category_proportions(_weights(spark, d), cats)
    return p.select("category", r6("proportion").alias("proportion"))


@register("category_proportions_all_docs", _props_sql("(SELECT CAST(count(*) AS DOUBLE) FROM doc_topics)"))
def q_props_all(spark, d):
    cats = M.category_vecs(spark).select("category")
    p = search.category_proportions(_weights(spark, d), cats, M.doc_topics(spark, d), mode="all_docs")
    return p.select("category", r6("proportion").alias("proportion"))


# C3 / H7 -----------------------------------------------------------------
@register("keyword_similarity", f"""{W}, {_BENCH_VEC},
kw AS (SELECT item_id AS keyword_id, dim, value FROM qvec),
{M.sql_cosine_long('doc_vecs', 'doc_id', 'kw', 'keyword_id', 'ksim')}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(keyword_id AS BIGINT) AS keyword_id,
       round(similarity, 6) AS similarity FROM ksim""")
def q_keyword_similarity(spark, d):
    kw = M.benchmark_vecs(spark, d).select(F.col("query_id").alias("keyword"), "embedding")
    s = search.keyword_similarity(M.doc_vectors(spark, d), kw)
    return s.select(big("doc_id").alias("doc_id"), big("keyword").alias("keyword_id"),
                    r6("similarity").alias("similarity"))


@register("keyword_similarity_map", f"""{W}, {_BENCH_VEC},
kw AS (SELECT item_id AS keyword_id, dim, value FROM qvec),
{M.sql_cosine_long('doc_vecs', 'doc_id', 'kw', 'keyword_id', 'ksim')}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(count(*) AS BIGINT) AS n, round(max(similarity), 6) AS most,
       round(min(similarity), 6) AS least FROM ksim GROUP BY doc_id""")
def q_keyword_similarity_map(spark, d):
    kw = M.benchmark_vecs(spark, d).select(F.col("query_id").alias("keyword"), "embedding")
    s = search.keyword_similarity(M.doc_vectors(spark, d), kw, as_map=True)
    v = F.map_values("similarity_scores")
    return s.select(big("doc_id").alias("doc_id"), big(F.size(v)).alias("n"), r6(F.array_max(v)).alias("most"),
                    r6(F.array_min(v)).alias("least"))


# F10 / H8 ----------------------------------------------------------------
def _bigram_sql() -> str:
    from agora.plans.sqlfrag import ngrams_expr
    toks = tokens_expr("text")
    return f"""{M.sql_groups()},
bg AS (SELECT doc_id, unnest({ngrams_expr('t', 2, 2)}) AS term
       FROM (SELECT doc_id, {toks} AS t FROM corpus)),
gcount AS (SELECT g.grp, b.term, count(*) AS cnt
           FROM bg b JOIN doc_topics dt ON dt.doc_id = b.doc_id JOIN groups g ON g.topic = dt.topic
           GROUP BY g.grp, b.term),
gtop AS (SELECT * FROM (SELECT grp, term, cnt,
                               row_number() OVER (PARTITION BY grp ORDER BY cnt DESC, term) AS rank FROM gcount)
         WHERE rank <= 30)"""


def _group_bigrams(spark, d):
    return terms.group_top_bigrams(M.clustered_corpus(spark, d), M.topic_mapping(spark, d), M.groups(spark), top_n=30)


@register("group_top_bigrams", f"""{W}, {_bigram_sql()}
SELECT grp AS "group", CAST(rank AS BIGINT) AS rank, term AS bigram, CAST(cnt AS BIGINT) AS count FROM gtop""")
def q_group_bigrams(spark, d):
    return _group_bigrams(spark, d).select("group", big("rank").alias("rank"), "bigram", big("count").alias("count"))


# two passes: bounded summaries name the candidates, which are counted exactly
@register("source_top_bigrams", f"""
WITH t AS MATERIALIZED (SELECT source, {tokens_expr("text")} AS toks FROM documents WHERE source IS NOT NULL),
g AS (SELECT source, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM t),
c AS (SELECT source, term, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c)
SELECT source, CAST(rank AS BIGINT) AS rank, term, CAST(n AS BIGINT) AS n FROM r WHERE rank <= 30""")
def q_source_top_bigrams(spark, d):
    top = heavy.frequent_terms(M.fx.docs(spark, d).select("source", "text"), "source", 30, min_n=2, max_n=2)
    return top.select("source", big("rank").alias("rank"), "term", big("n").alias("n"))


@register("group_rollup", f"""{W}, {_bigram_sql()}
SELECT g.grp AS label, '' AS parent, CAST(count(*) AS DOUBLE) AS value
FROM doc_topics dt JOIN groups g ON g.topic = dt.topic GROUP BY g.grp
UNION ALL SELECT term, grp, cnt * 2.0 FROM gtop""")
def q_group_rollup(spark, d):
    r = search.group_rollup(M.doc_topics(spark, d), M.groups(spark), _group_bigrams(spark, d))
    return r.select("label", "parent", r6("value").alias("value"))


# H9 ----------------------------------------------------------------------
@register("group_subthemes", f"""{W}, {M.sql_groups()},
s AS (SELECT g.grp, w.term, sum(w.score) * 2.0 AS value FROM words w JOIN groups g ON g.topic = w.topic
      GROUP BY g.grp, w.term),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(value, 9) DESC, term) AS rank FROM s)
SELECT grp AS "group", CAST(rank AS BIGINT) AS rank, term, round(value, 6) AS value FROM r""")
def q_group_subthemes(spark, d):
    r = search.group_subthemes(M.words(spark, d), M.groups(spark))
    return r.select("group", big("rank").alias("rank"), "term", r6("value").alias("value"))


# H10 ---------------------------------------------------------------------
@register("topic_keyword_pool", f"""{W}, {M.sql_selected()},
best AS (SELECT * FROM words WHERE topic IN (SELECT topic FROM selected)
         ORDER BY round(score, 9) DESC, term, topic LIMIT 500)
SELECT term, round(min(score), 6) AS weight FROM best GROUP BY term""")
def q_keyword_pool(spark, d):
    r = search.topic_keyword_pool(M.words(spark, d), M.selected_topics(spark), 500)
    return r.select("term", r6("weight").alias("weight"))


# H11 ---------------------------------------------------------------------
@register("topic_rollup", f"""{W}, {M.sql_selected()}
SELECT 'Topic ' || CAST(topic AS VARCHAR) AS label, '' AS parent, round(count(*) * 0.1, 6) AS value
FROM doc_topics WHERE topic IN (SELECT topic FROM selected) GROUP BY topic
UNION ALL
SELECT term, 'Topic ' || CAST(topic AS VARCHAR), round(score, 6) FROM words
WHERE topic IN (SELECT topic FROM selected) AND rank <= 10""")
def q_topic_rollup(spark, d):
    r = search.topic_rollup(M.doc_topics(spark, d), M.words(spark, d), M.selected_topics(spark))
    return r.select("label", "parent", r6("value").alias("value"))


# F11–F13 -----------------------------------------------------------------
def _chunks_sql() -> str:
    return """words_ AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') AS w
             FROM corpus),
chunks AS (SELECT doc_id, i AS chunk_no, array_to_string(w[i * 512 + 1:(i + 1) * 512], ' ') AS chunk
           FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 512.0) AS BIGINT))) AS i FROM words_))"""


@register("chunk_words", f"""{W}, {_chunks_sql()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(chunk_no AS BIGINT) AS chunk_no,
       CAST(length(chunk) AS BIGINT) AS n_chars, md5(chunk) AS chunk_md5 FROM chunks""")
def q_chunk_words(spark, d):
    c = sentiment.chunk_words(M.corpus(spark, d))
    return c.select(big("doc_id").alias("doc_id"), big("chunk_no").alias("chunk_no"),
                    F.char_length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def _sent_sql() -> str:
    from agora.plans.sqlfrag import sql_list
    toks = tokens_expr("chunk", stop=False)
    pos, neg = sql_list(sentiment.POSITIVE_WORDS), sql_list(sentiment.NEGATIVE_WORDS)
    return f"""{_chunks_sql()},
scored AS (SELECT doc_id, chunk_no,
                  len(list_filter({toks}, lambda t: list_contains({pos}, t)))
                  - len(list_filter({toks}, lambda t: list_contains({neg}, t))) AS score
           FROM chunks),
cls AS (SELECT *, CASE WHEN score < 0 THEN 'Negative' WHEN score > 0 THEN 'Positive' ELSE 'Neutral' END
                  AS sentiment FROM scored)"""


@register("score_sentiment", f"""{W}, {_sent_sql()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(score AS BIGINT) AS score,
       sentiment FROM cls""")
def q_score_sentiment(spark, d):
    s = sentiment.lexicon_sentiment(sentiment.chunk_words(M.corpus(spark, d)))
    return s.select(big("doc_id").alias("doc_id"), big("chunk_no").alias("chunk_no"), big("score").alias("score"),
                    "sentiment")


@register("topic_sentiment", f"""{W}, {_sent_sql()}
SELECT CAST(dt.topic AS BIGINT) AS topic,
       round(avg(CASE WHEN sentiment = 'Negative' THEN 1.0 ELSE 0.0 END), 6) AS negative,
       round(avg(CASE WHEN sentiment = 'Neutral' THEN 1.0 ELSE 0.0 END), 6) AS neutral,
       round(avg(CASE WHEN sentiment = 'Positive' THEN 1.0 ELSE 0.0 END), 6) AS positive,
       CAST(count(*) AS BIGINT) AS chunks
FROM cls JOIN doc_topics dt ON dt.doc_id = cls.doc_id WHERE dt.topic <> -1 GROUP BY dt.topic""")
def q_topic_sentiment(spark, d):
    s = sentiment.lexicon_sentiment(sentiment.chunk_words(M.corpus(spark, d)))
    t = sentiment.topic_sentiment(s, M.doc_topics(spark, d))
    return t.select(big("topic").alias("topic"), r6("negative").alias("negative"), r6("neutral").alias("neutral"),
                    r6("positive").alias("positive"), big("chunks").alias("chunks"))
