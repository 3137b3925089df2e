"""The shared topic-model plan over the test tables, in Spark and as
DuckDB CTEs (so every registered query derives from whole tables).

Corpus: all ``documents`` (text = clean-else-raw). Given clusters: the
number in ``source`` (src0 = noise). Document vectors: the default hashing
embedder. Topic groups and category queries are parameter tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.constants import CATEGORY_QUERIES
from agora.operators import embed, search, topics, vectors
from agora.plans.sqlfrag import DOCS, SRC_CLUSTERS, sql_str, tokens_expr
from agora.sources import fixtures as fx

DIM = 64
MIN_DF, MAX_DF = 10, 0.6
CANDIDATES = 30
# Topic groups over the renumbered topics (overlapping, like
# the reference's hand-made lists).
TOPIC_GROUPS = (
    ("Transportation", (0, 1, 2, 3)),
    ("Clean Energy", (3, 4, 5, 6)),
    ("Forestry", (6, 7, 8, 0)),
    ("Activism", (9, 10, 11, 3)),
    ("Policy", (12, 13, 14, 9)),
    ("Fossil Fuels", (15, 16, 17, 18)),
)
SELECTED_TOPICS = (0, 3, 6, 9, 12)
CATEGORY_THRESHOLD_FIXTURE = 0.1


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return fx.docs(spark, d).select("doc_id", F.coalesce("clean_text", "text").alias("text"), "lang", "source")


def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    return embed.embed_text(corpus(spark, d), "text", "doc_id", dim=DIM)


def doc_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics.assign_topics(fx.source_clusters(spark, d))


def topic_mapping(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_mapping(fx.source_clusters(spark, d))


def clustered_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus, every document with its given cluster."""
    return corpus(spark, d).withColumn("cluster", fx.source_cluster())


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return topics.class_term_counts(clustered_corpus(spark, d), topic_mapping(spark, d))


def pruned_counts(spark: SparkSession, d: str) -> DataFrame:
    return topics.prune_class_vocab(class_counts(spark, d), MIN_DF, MAX_DF)


def ctfidf(spark: SparkSession, d: str) -> DataFrame:
    return topics.ctfidf(pruned_counts(spark, d))


def words(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    return topics.topic_words(ctfidf(spark, d), n)


def topic_vecs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.topic_vectors(doc_vectors(spark, d), doc_topics(spark, d))


def groups(spark: SparkSession) -> DataFrame:
    rows = [(g, t) for g, ts in TOPIC_GROUPS for t in ts]
    return spark.createDataFrame(rows, "group string, topic int")


def selected_topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in SELECTED_TOPICS], "topic int")


def category_vecs(spark: SparkSession) -> DataFrame:
    cats = spark.createDataFrame(list(CATEGORY_QUERIES), "category string, query string")
    return search.embed_queries(cats, "query", "category", dim=DIM)


def benchmark_vecs(spark: SparkSession, d: str) -> DataFrame:
    b = fx.benchmark_queries(spark, d)
    e = embed.embed_text(b, "query", "query_id", dim=DIM)
    return b.join(e, "query_id")


# ------------------------------------------------------------- SQL side ----

def sql_groups() -> str:
    rows = ", ".join(f"({sql_str(g)}, {t})" for g, ts in TOPIC_GROUPS for t in ts)
    return f"groups(grp, topic) AS (VALUES {rows})"


def sql_selected() -> str:
    return "selected(topic) AS (VALUES " + ", ".join(f"({t})" for t in SELECTED_TOPICS) + ")"


def sql_categories() -> str:
    rows = ", ".join(f"({sql_str(c)}, {sql_str(q)})" for c, q in CATEGORY_QUERIES)
    return f"categories(category, query) AS (VALUES {rows})"


def sql_hash_embed(name: str, src: str, key: str, text: str, dim: int = DIM) -> str:
    """CTEs ``{name}`` = (key, dim, value) non-zero entries of the L2-normalised
    hashed vector (first 1,024 tokens)."""
    toks = tokens_expr(text, stop=False)
    return f"""{name}_tok AS (SELECT {key} AS k, unnest(({toks})[1:1024]) AS tok FROM {src}),
{name}_b AS (SELECT k, ('0x' || substr(md5(tok), 1, 6))::BIGINT % {dim} AS dim,
                    CASE WHEN ('0x' || substr(md5(tok), 7, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS s
             FROM {name}_tok),
{name}_s AS (SELECT k, dim, CAST(sum(s) AS DOUBLE) AS v FROM {name}_b GROUP BY k, dim),
{name}_n AS (SELECT k, sqrt(sum(v * v)) AS nrm FROM {name}_s GROUP BY k),
{name} AS (SELECT s.k AS {key}, s.dim, s.v / greatest(n.nrm, 1e-12) AS value
           FROM {name}_s s JOIN {name}_n n ON s.k = n.k WHERE s.v <> 0)"""


def sql_model() -> str:
    """CTE chain: docs, clusters, doc_vecs, doc_topics, counts, cc, ctfidf,
    words (top 10), cand (top 30), topic_vecs (topic, dim, value), tnorm."""
    toks = tokens_expr("text")
    return f"""{DOCS}, {SRC_CLUSTERS},
corpus AS (SELECT doc_id, coalesce(clean_text, text) AS text, lang, source FROM docs),
{sql_hash_embed('doc_vecs', 'corpus', 'doc_id', 'text')},
sizes AS (SELECT cluster, count(*) AS size FROM clusters WHERE cluster <> -1 GROUP BY cluster),
mapping AS (SELECT cluster, row_number() OVER (ORDER BY size DESC, cluster ASC) - 1 AS topic FROM sizes),
doc_topics AS (SELECT c.doc_id, coalesce(m.topic, -1) AS topic
               FROM clusters c LEFT JOIN mapping m ON c.cluster = m.cluster),
counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS n
           FROM (SELECT doc_id, unnest({toks}) AS term FROM corpus) GROUP BY doc_id, term),
cc_raw AS MATERIALIZED (SELECT t.topic, c.term, sum(c.n) AS n FROM counts c JOIN doc_topics t ON c.doc_id = t.doc_id
           WHERE t.topic <> -1 GROUP BY t.topic, c.term),
tstats AS MATERIALIZED (SELECT term, count(*) AS df FROM cc_raw GROUP BY term),
cc AS MATERIALIZED (SELECT * FROM cc_raw WHERE term IN (
         SELECT term FROM tstats WHERE df >= {MIN_DF}
           AND df <= {MAX_DF} * (SELECT count(DISTINCT topic) FROM cc_raw))),
rowsum AS (SELECT topic, sum(n) AS row_n FROM cc GROUP BY topic),
ft AS (SELECT term, sum(n) AS f_t FROM cc GROUP BY term),
ctfidf AS (SELECT cc.topic, cc.term,
                  cc.n / r.row_n * ln(1 + (SELECT floor(avg(row_n)) FROM rowsum) / ft.f_t) AS score
           FROM cc JOIN rowsum r ON cc.topic = r.topic JOIN ft ON cc.term = ft.term),
ranked_words AS (SELECT topic, term, score,
                        row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank
                 FROM ctfidf),
words AS (SELECT * FROM ranked_words WHERE rank <= 10),
cand AS (SELECT * FROM ranked_words WHERE rank <= {CANDIDATES}),
tsize AS (SELECT topic, count(*) AS n FROM doc_topics WHERE topic <> -1 GROUP BY topic),
topic_vecs AS (SELECT t.topic, v.dim, sum(v.value) / any_value(z.n) AS value
               FROM doc_vecs v JOIN doc_topics t ON v.doc_id = t.doc_id JOIN tsize z ON t.topic = z.topic
               GROUP BY t.topic, v.dim),
tnorm AS (SELECT topic, sqrt(sum(value * value)) AS nrm FROM topic_vecs GROUP BY topic)"""


def sql_cosine_long(a: str, a_key: str, b: str, b_key: str, out: str) -> str:
    """CTE ``{out}`` = (a_key, b_key, similarity) between two long-form
    vector tables (key, dim, value); pairs with no shared dimension get 0
    via the caller's outer join when needed."""
    return f"""{out}_an AS (SELECT {a_key}, sqrt(sum(value * value)) AS nrm FROM {a} GROUP BY {a_key}),
{out}_bn AS (SELECT {b_key}, sqrt(sum(value * value)) AS nrm FROM {b} GROUP BY {b_key}),
{out}_dot AS (SELECT x.{a_key}, y.{b_key}, sum(x.value * y.value) AS d
              FROM {a} x JOIN {b} y ON x.dim = y.dim GROUP BY x.{a_key}, y.{b_key}),
{out} AS (SELECT an.{a_key}, bn.{b_key},
                 CASE WHEN an.nrm = 0 OR bn.nrm = 0 THEN 0.0
                      ELSE coalesce(d.d, 0.0) / (an.nrm * bn.nrm) END AS similarity
          FROM {out}_an an CROSS JOIN {out}_bn bn
          LEFT JOIN {out}_dot d ON d.{a_key} = an.{a_key} AND d.{b_key} = bn.{b_key})"""
