"""Registered queries (Spark) and their independent DuckDB oracle SQL.

Every query reads whole test tables (or data Spark derives from them);
outputs use BIGINT / DOUBLE (rounded to 6 decimals) / VARCHAR columns with
identical names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators import terms
from agora.plans.sqlfrag import DOCS, SRC_CLUSTERS, ngrams_expr, tokens_expr
from agora.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ---------------------------------------------------------------- F1–F9 ----

def _tfidf_sql(min_n: int, max_n: int, top_n: int = 15, max_features: int = 4999) -> str:
    toks = tokens_expr("coalesce(clean_text, text)")
    return f"""
WITH {DOCS}, {SRC_CLUSTERS},
toks AS (SELECT doc_id, {ngrams_expr('t', min_n, max_n)} AS terms
         FROM (SELECT doc_id, {toks} AS t FROM docs)),
counts AS (SELECT doc_id, term, count(*) AS n
           FROM (SELECT doc_id, unnest(terms) AS term FROM toks) GROUP BY doc_id, term),
stats AS (SELECT term, sum(n) AS total, count(*) AS df FROM counts GROUP BY term),
vocab AS (SELECT term, df FROM stats ORDER BY total DESC, term ASC LIMIT {max_features}),
w AS (SELECT c.doc_id, c.term,
             c.n * (ln((1.0 + (SELECT count(*) FROM docs)) / (v.df + 1.0)) + 1.0) AS w
      FROM counts c JOIN vocab v ON c.term = v.term),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id),
wc AS (SELECT w.doc_id, w.term, w.w / norms.nrm AS tfidf, cl.cluster
       FROM w JOIN norms ON w.doc_id = norms.doc_id JOIN clusters cl ON w.doc_id = cl.doc_id),
sizes AS (SELECT cluster, count(*) AS size FROM clusters WHERE cluster <> -1 GROUP BY cluster),
means AS (SELECT wc.cluster, wc.term, sum(wc.tfidf) / any_value(s.size) AS score
          FROM wc JOIN sizes s ON wc.cluster = s.cluster GROUP BY wc.cluster, wc.term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster
                                        ORDER BY round(score, 9) DESC, term ASC) AS rank FROM means)
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(rank AS BIGINT) AS rank, term,
       round(score, 6) AS score
FROM ranked WHERE rank <= {top_n}"""


def _cluster_top_terms(min_n: int, max_n: int):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        clusters = fx.source_clusters(spark, sf_dir)
        docs = fx.docs(spark, sf_dir).withColumn("text", F.coalesce("clean_text", "text")).withColumn(
            "cluster", fx.source_cluster())
        out = terms.cluster_top_terms(docs, clusters, min_n=min_n, max_n=max_n)
        return out.select(big("cluster").alias("cluster"), big("rank").alias("rank"), "term",
                          r6("score").alias("score"))
    return q


register("cluster_top_terms", _tfidf_sql(1, 1))(_cluster_top_terms(1, 1))
register("cluster_top_terms_1_2", _tfidf_sql(1, 2))(_cluster_top_terms(1, 2))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["cluster_top_terms"](spark, sf_dir)


# Registration modules (import order = listing order).
from agora.plans import q_topics  # noqa: E402,F401
from agora.plans import q_vectors  # noqa: E402,F401
from agora.plans import q_graph  # noqa: E402,F401
