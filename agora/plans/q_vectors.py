"""Registered queries: sources, per-row expressions, joins, vector
operators, neighbours and density statistics (A, B, C, D, E)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agora.functions import maps as MP
from agora.functions import text as T
from agora.functions import vectors as V
from agora.operators import density, joins, knn, vectors
from agora.plans import model as M
from agora.plans.catalog import ORACLE, big, r6, register
from agora.plans.sqlfrag import DOCS, VEC_CLUSTERS, VECTORS, tokens_expr
from agora.session import scratch_path, write_shared
from agora.sources import fixtures as fx
from agora.sources import io

# A -----------------------------------------------------------------------


@register("read_vectors", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(len(embedding)) AS BIGINT) AS dim_min,
       CAST(max(len(embedding)) AS BIGINT) AS dim_max FROM embeddings""")
def q_read_vectors(spark, d):
    v = io.read_vectors(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")
    return io.vector_stats(v)


@register("read_batches", """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, CAST(conv_id % 4 AS BIGINT) AS batch,
       CAST(length(text) AS BIGINT) AS n_chars FROM conversations""")
def q_read_batches(spark, d):
    paths = [f"{d}/conversations.parquet"]
    b = io.read_batches(spark, paths)
    return b.select(big(F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                    big(F.col("conv_id") % 4).alias("batch"), big(F.char_length("text")).alias("n_chars"))


# batches as they were written, listed in another order, the first of them twice
_MANIFEST = (2, 0, 3, 1, 2)


@register("read_manifest", f"""
WITH listed(b, place) AS (VALUES {", ".join(f"({b}, {i})" for i, b in enumerate(_MANIFEST))})
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, CAST(place AS BIGINT) AS batch,
       CAST(length(text) AS BIGINT) AS n_chars FROM conversations JOIN listed ON conv_id % 4 = b""")
def q_read_manifest(spark, d):
    rows = fx.table(spark, d, "conversations")
    path = scratch_path(spark, f"agora-{uuid.uuid4().hex}/batches")
    rows.withColumn("part", F.col("conv_id") % 4).write.partitionBy("part").parquet(path)
    b = io.read_manifest(spark, [f"{path}/part={i}" for i in _MANIFEST])
    return b.select(big(F.col("conv_id") * 1000 + F.col("turn")).alias("id"), big("batch").alias("batch"),
                    big(F.char_length("text")).alias("n_chars"))


@register("cluster_report", f"""SELECT cluster, 'Cluster ' || cluster || ':' || chr(10)
  || string_agg(term || ': ' || printf('%.6f', score), chr(10) ORDER BY rank) AS report
FROM ({ORACLE["cluster_top_terms"]}) GROUP BY cluster""")
def q_cluster_report(spark, d):
    from agora.plans.catalog import QUERIES
    top = QUERIES["cluster_top_terms"](spark, d)
    return io.cluster_report(top).select(big("cluster").alias("cluster"), "report")


@register("attach_labels", """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id,
  CASE WHEN conv_id % 3 = 0 THEN 'Unknown' ELSE CAST(turn % 5 AS VARCHAR) END AS label, role
FROM conversations""")
def q_attach_labels(spark, d):
    chunks = fx.conversation_chunks(spark, d)
    labels = fx.table(spark, d, "conversations").filter("conv_id % 3 <> 0").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 5).cast("int").alias("cluster"))
    out = io.attach_labels(chunks, labels)
    return out.select(big("id").alias("id"), MP.metadata_get("metadata", "umap_cluster").alias("label"),
                      MP.metadata_get("metadata", "role").alias("role"))


# B -----------------------------------------------------------------------

@register("parse_embedding", """
SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(len(e) AS BIGINT) AS n, round(list_sum(CAST(e AS DOUBLE[])), 6) AS s
FROM (SELECT vec_id, CAST(from_json(to_json(embedding), '["FLOAT"]') AS FLOAT[]) AS e FROM embeddings)""")
def q_parse_embedding(spark, d):
    v = fx.vectors(spark, d).select("doc_id", V.to_float32(V.parse_embedding(F.to_json("embedding"))).alias("e"))
    return v.select(big("doc_id").alias("doc_id"), big(F.size("e")).alias("n"),
                    r6(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("s"))


@register("coalesce_content", f"""WITH {DOCS}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(coalesce(clean_text, text)) AS BIGINT) AS content_chars,
       CAST(clean_text IS NOT NULL AS BIGINT) AS from_clean FROM docs""")
def q_coalesce_content(spark, d):
    x = fx.docs(spark, d)
    return x.select(big("doc_id").alias("doc_id"), T.text_length(T.coalesce_text()).alias("content_chars"),
                    big(F.col("clean_text").isNotNull().cast("int")).alias("from_clean"))


_PAGES_SQL = r"""pg AS (
  SELECT page_id AS doc_id, regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS domain,
         regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t0, html FROM pages),
pg2 AS (SELECT doc_id, domain, CASE WHEN t0 = '' THEN NULL ELSE t0 END AS title,
               trim(regexp_replace(regexp_replace(t0, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS c0, html
        FROM pg),
web AS (SELECT doc_id, domain, title, CASE WHEN c0 = '' THEN NULL ELSE c0 END AS cleaned_title, html AS text FROM pg2)"""


@register("coalesce_title", f"""WITH {_PAGES_SQL}
SELECT CAST(doc_id AS BIGINT) AS doc_id, domain, coalesce(cleaned_title, title) AS title FROM web""")
def q_coalesce_title(spark, d):
    w = fx.web_docs(spark, d)
    return w.select(big("doc_id").alias("doc_id"), "domain", F.coalesce("cleaned_title", "title").alias("title"))


@register("drop_noise", f"""WITH {VEC_CLUSTERS}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(cluster AS BIGINT) AS cluster FROM vclusters WHERE cluster <> -1""")
def q_drop_noise(spark, d):
    c = fx.vector_clusters(spark, d).where(F.col("cluster") != -1)
    return c.select(big("doc_id").alias("doc_id"), big("cluster").alias("cluster"))


@register("valid_text", f"""WITH {DOCS}
SELECT CAST(doc_id AS BIGINT) AS doc_id FROM docs WHERE clean_text IS NOT NULL""")
def q_valid_text(spark, d):
    return fx.docs(spark, d).where(F.col("clean_text").isNotNull()).select(big("doc_id").alias("doc_id"))


@register("topic_filter", f"""WITH {M.sql_model()}, {M.sql_selected()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(topic AS BIGINT) AS topic FROM doc_topics
WHERE topic IN (SELECT topic FROM selected)""")
def q_topic_filter(spark, d):
    dt = M.doc_topics(spark, d).where(F.col("topic").isin(list(M.SELECTED_TOPICS)))
    return dt.select(big("doc_id").alias("doc_id"), big("topic").alias("topic"))


@register("drop_embedding", """
SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(label AS BIGINT) AS label FROM embeddings""")
def q_drop_embedding(spark, d):
    e = fx.table(spark, d, "embeddings").drop("embedding")
    return e.select(big("vec_id").alias("doc_id"), big("label").alias("label"))


_EXCERPT_SQL = r"""regexp_replace(regexp_replace(trim(regexp_replace(substr(text, 1, 900), '\s+', ' ', 'g')),
                   '(.{1,100})(\s+|$)', '\1<br>', 'g'), '<br>$', '')"""


@register("excerpt", f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, {_EXCERPT_SQL} AS excerpt FROM documents""")
def q_excerpt(spark, d):
    x = fx.table(spark, d, "documents")
    return x.select(big("doc_id").alias("doc_id"), T.excerpt("text").alias("excerpt"))


@register("text_length", """SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(text) AS BIGINT) AS n_chars
FROM documents""")
def q_text_length(spark, d):
    x = fx.table(spark, d, "documents")
    return x.select(big("doc_id").alias("doc_id"), T.text_length("text").alias("n_chars"))


@register("metadata_get_set", """
SELECT CAST(event_id AS BIGINT) AS event_id, coalesce(json_extract_string(props, '$.k'), 'Unknown') AS k,
       'Unknown' AS missing, event_type AS set_value,
       CAST(len(list_distinct(list_concat(json_keys(props::JSON), ['event_type']))) AS BIGINT) AS n_keys
FROM events""")
def q_metadata(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "event_type", MP.json_to_map("props").alias("m"))
    m2 = MP.metadata_set("m", "event_type", F.col("event_type"))
    return e.select(big("event_id").alias("event_id"), MP.metadata_get("m", "k").alias("k"),
                    MP.metadata_get("m", "zz").alias("missing"),
                    F.element_at(m2, F.lit("event_type")).alias("set_value"),
                    big(F.size(m2)).alias("n_keys"))


def _proj_sql(k: int, seed: int = 0, dim: int = 64) -> str:
    s = 1.0 / (k ** 0.5)
    return f"""rp AS (SELECT i, j, CASE WHEN ('0x' || substr(md5('{seed}:' || i || ':' || j), 1, 1))::INTEGER % 2 = 0
                             THEN {s!r} ELSE -{s!r} END AS r
              FROM range(0, {dim}) t1(i), range(0, {k}) t2(j)),
ve AS (SELECT vec_id AS doc_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
              generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
proj AS (SELECT ve.doc_id, rp.j, sum(ve.x * rp.r) AS value FROM ve JOIN rp ON rp.i = ve.i GROUP BY ve.doc_id, rp.j)"""


@register("random_projection", f"""WITH {_proj_sql(8)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(j AS BIGINT) AS dim, round(value, 6) AS value FROM proj""")
def q_random_projection(spark, d):
    p = vectors.random_projection(fx.vectors(spark, d), 64, 8)
    return vectors.long_form(p, "doc_id", "projected").select(
        big("doc_id").alias("doc_id"), big("dim").alias("dim"), r6("value").alias("value"))


@register("plot_points", f"""WITH {_proj_sql(3)}, {VEC_CLUSTERS},
xyz AS (SELECT doc_id, max(CASE WHEN j = 0 THEN value END) AS x, max(CASE WHEN j = 1 THEN value END) AS y,
               max(CASE WHEN j = 2 THEN value END) AS z FROM proj GROUP BY doc_id)
SELECT CAST(p.doc_id AS BIGINT) AS doc_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z,
       CAST(c.cluster AS BIGINT) AS cluster, CAST(length(d.text) AS BIGINT) AS length,
       {_EXCERPT_SQL.replace('text', 'd.text')} AS excerpt
FROM xyz p JOIN vclusters c ON c.doc_id = p.doc_id LEFT JOIN documents d ON d.doc_id = p.doc_id""")
def q_plot_points(spark, d):
    p = vectors.random_projection(fx.labelled_vectors(spark, d), 64, 3)
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    j = p.join(docs, "doc_id", "left")
    return j.select(big("doc_id").alias("doc_id"), r6(F.col("projected")[0]).alias("x"),
                    r6(F.col("projected")[1]).alias("y"), r6(F.col("projected")[2]).alias("z"),
                    big("cluster").alias("cluster"), T.text_length("text").alias("length"),
                    T.excerpt("text").alias("excerpt"))


# C -----------------------------------------------------------------------

@register("attach_by_key", f"""WITH {DOCS}, {VECTORS}
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(v.doc_id IS NOT NULL AS BIGINT) AS has_vector,
       CAST(coalesce(len(v.embedding), 0) AS BIGINT) AS dim
FROM docs d LEFT JOIN vectors v ON v.doc_id = d.doc_id""")
def q_attach(spark, d):
    j = joins.attach_by_key(fx.docs(spark, d).select("doc_id"), fx.vectors(spark, d))
    has = F.col("embedding").isNotNull()
    return j.select(big("doc_id").alias("doc_id"), big(has.cast("int")).alias("has_vector"),
                    big(F.when(has, F.size("embedding")).otherwise(0)).alias("dim"))


@register("positional_subset", """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, CAST(length(text) AS BIGINT) AS n_chars
FROM conversations WHERE role = 'user'""")
def q_subset(spark, d):
    ch = fx.conversation_chunks(spark, d)
    ids = ch.where(MP.metadata_get("metadata", "role") == "user").select("id")
    s = joins.subset_by_ids(ch, ids, "id")
    return s.select(big("id").alias("id"), big(F.char_length("document")).alias("n_chars"))


# D -----------------------------------------------------------------------

@register("l2_normalize", """
WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + label)) AS e FROM embeddings),
u AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim,
             greatest(sqrt(list_dot_product(e, e)), 1e-12) AS nrm FROM s)
SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(dim AS BIGINT) AS dim, round(x / nrm, 6) AS value FROM u""")
def q_l2(spark, d):
    e = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("embedding"))
    n = vectors.normalize(e)
    return vectors.long_form(n).select(big("doc_id").alias("doc_id"), big("dim").alias("dim"),
                                       r6("value").alias("value"))


@register("quantize", """
WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim
           FROM embeddings)
SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(dim AS BIGINT) AS dim,
       CAST(round_even((least(greatest(x, -1.0), 1.0) + 1) / 2 * 65535, 0) AS BIGINT) AS q FROM u""")
def q_quantize(spark, d):
    q = vectors.quantize(fx.vectors(spark, d))
    return vectors.long_form(q, "doc_id", "quantized", "dim", "q").select(
        big("doc_id").alias("doc_id"), big("dim").alias("dim"), big("q").alias("q"))


@register("dequantize", """
WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim
           FROM embeddings),
q AS (SELECT vec_id, dim, round_even((least(greatest(x, -1.0), 1.0) + 1) / 2 * 65535, 0) AS q FROM u)
SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(dim AS BIGINT) AS dim, round(q / 65535.0 * 2 - 1, 6) AS value FROM q""")
def q_dequantize(spark, d):
    q = vectors.dequantize(vectors.quantize(fx.vectors(spark, d)), "quantized", out="deq")
    return vectors.long_form(q, "doc_id", "deq").select(
        big("doc_id").alias("doc_id"), big("dim").alias("dim"), r6("value").alias("value"))


@register("cosine_similarity", """
SELECT CAST(a.vec_id AS BIGINT) AS doc_id, CAST(b.vec_id AS BIGINT) AS next_id,
       round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
             / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6)
       AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine(spark, d):
    v = fx.vectors(spark, d)
    nxt = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next_id"),
                   F.col("embedding").alias("e2"))
    j = v.join(nxt, "doc_id")
    return j.select(big("doc_id").alias("doc_id"), big("next_id").alias("next_id"),
                    r6(V.cosine("embedding", "e2")).alias("similarity"))


@register("truncate_tokens", f"""WITH {DOCS}
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CAST(len(({tokens_expr('coalesce(clean_text, text)', stop=False)})[1:1024]) AS BIGINT) AS n_tokens FROM docs""")
def q_truncate(spark, d):
    x = fx.docs(spark, d)
    t = T.truncate_tokens(T.tokenize(T.coalesce_text()), 1024)
    return x.select(big("doc_id").alias("doc_id"), big(F.size(t)).alias("n_tokens"))


# C6 / C7 -----------------------------------------------------------------

def _knn_sql(k: int | None, table: str = "embeddings", deq: bool = False) -> str:
    vec = "CAST(embedding AS DOUBLE[])"
    if deq:
        vec = ("list_transform(CAST(embedding AS DOUBLE[]), lambda x: "
               "round_even((least(greatest(x, -1.0), 1.0) + 1) / 2 * 65535, 0) / 65535.0 * 2 - 1)")
    return f"""WITH v AS (SELECT vec_id AS id, {vec} AS e FROM {table}),
n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS nrm FROM v),
p AS (SELECT a.id AS src, b.id AS dst,
             1.0 - CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0
                        ELSE list_dot_product(a.e, b.e) / (a.nrm * b.nrm) END AS distance
      FROM n a JOIN n b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 9), dst) AS rank FROM p)
SELECT CAST(src AS BIGINT) AS src, CAST(rank AS BIGINT) AS rank, CAST(dst AS BIGINT) AS dst,
       round(distance, 6) AS distance FROM r{"" if k is None else f" WHERE rank <= {k}"}"""


def _knn_out(df):
    return df.select(big("src").alias("src"), big("rank").alias("rank"), big("dst").alias("dst"),
                     r6("distance").alias("distance"))


@register("knn_exact", _knn_sql(5))
def q_knn_exact(spark, d):
    return _knn_out(knn.knn_exact(fx.vectors(spark, d), 5, block_rows=256))


# the whole matrix but its diagonal
@register("pairwise_cosine_distance", _knn_sql(None, deq=True))
def q_pairwise(spark, d):
    v = vectors.dequantize(vectors.quantize(fx.vectors(spark, d)), "quantized", out="embedding")
    return _knn_out(knn.pairwise_distances(v))


@register("knn_lsh")
def q_knn_lsh(spark, d):
    return _knn_out(knn.knn_lsh(fx.vectors(spark, d), 5, dim=64))


# E9 / E10 ----------------------------------------------------------------

@register("cluster_sizes", f"""WITH {VEC_CLUSTERS}
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS size FROM vclusters GROUP BY cluster""")
def q_cluster_sizes(spark, d):
    s = density.cluster_sizes(fx.vector_clusters(spark, d))
    return s.select(big("cluster").alias("cluster"), big("size").alias("size"))


@register("n_clusters", f"""WITH {VEC_CLUSTERS}
SELECT CAST(count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS BIGINT) AS n_clusters FROM vclusters""")
def q_n_clusters(spark, d):
    return density.n_clusters(fx.vector_clusters(spark, d)).select(big("n_clusters").alias("n_clusters"))


@register("noise_ratio", f"""WITH {VEC_CLUSTERS}
SELECT round(avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio FROM vclusters""")
def q_noise_ratio(spark, d):
    return density.noise_ratio(fx.vector_clusters(spark, d)).select(r6("noise_ratio").alias("noise_ratio"))

