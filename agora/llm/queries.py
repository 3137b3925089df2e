"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from agora.llm import (capture_index, hard_negatives, jaccard_join, lang_id, license_scan, maxent_lm, mixing, packing, phrases,
                       quality_gbt, reply_trees, syncmers, topk_search)
from agora.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ chat formatting

_CONTROL = "</s>[INST] ok [/INST]"

_CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL}'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS written,
    replace(replace(replace(replace(coalesce(role, ''), '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS head
  FROM rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(head) + 1 + length(written) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@register("op2_reply_trees", _CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], rows.schema)
    done = reply_trees.format_trees(reply_trees.as_chain(
        rows.unionByName(extra), "conv_id", "turn", "role", "text"))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = done.withColumn("turns", reply_trees.read_turns(F.col("formatted"))).withColumn(
        "loss", reply_trees.loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        F.when(F.col("tree") != "null", F.substring("tree", 2, 30)).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# --------------------------------------------------------------------- mixing

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
    [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
-- raise the share from capped set to capped set: the k-th candidate caps the k smallest cap/weight
c AS (
  SELECT *, (SELECT sum(source_size) FROM w)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    (SELECT sum(weight) FROM w)
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM w),
share AS (SELECT rest / free AS share FROM c WHERE cap >= rest / free * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT share FROM share) * weight), cap) AS target FROM w),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_ FROM t),
-- the rows of one source in hash order; equal hashes stand together
g AS (
  SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash),
r AS (
  SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM g),
b AS (
  SELECT r.source, min(r.hash) AS hash FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source
  WHERE r.upto > f.target - f.full_ * f.source_size GROUP BY r.source),
e AS (
  SELECT b.source, b.hash + CASE WHEN 2 * (f.target - f.full_ * f.source_size - (r.upto - r.words)) >= r.words THEN 1 ELSE 0 END AS below
  FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source AND b.hash = r.hash JOIN f ON b.source IS NOT DISTINCT FROM f.source)
SELECT d.doc_id, d.size, f.source_size, f.target,
  CAST(d.size * (f.full_ + CASE WHEN d.hash < coalesce(e.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""


@register("op3_mix_sources", _MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


# ------------------------------------------------------- language and quality

@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (fold("doc_id", 3) == 1).alias("held_out"))
    known = lang_id.profiles(docs.filter("not held_out and lang is not null"), "text", "lang")
    return lang_id.identify(docs.drop("lang"), known, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


@register("op4_quality_gbt")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    forest = quality_gbt.train(docs, labels)
    return quality_gbt.score(docs, forest, keep_text=False).select("doc_id", "held_out", "score", "predicted")


# -------------------------------------------------------------- Jaccard join

@register("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


# -------------------------------------------------------------------- packing

@register("op6_pack_nnls")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# --------------------------------------------------------------------- search

_SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT q.vec_id AS query_id, row_number() OVER w AS rank, r.vec_id AS vec_id,
  CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score
FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 50 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, r.e) DESC, r.vec_id)
QUALIFY row_number() OVER w <= 5"""


@register("op7_topk_threshold", _SEARCH_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(topk_search.usable(F.col("embedding"))).select(
        "vec_id", topk_search.quantized(F.col("embedding")).alias("vector"))
    queries = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return topk_search.search(queries, rows, 5)


# ------------------------------------------------------- language-model scores

@register("op8_maxent_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    scored = maxent_lm.score(docs.withColumn("train", ~F.col("held_out")))
    return scored.withColumn("held_out", fold("doc_id", 5) == 1)


# --------------------------------------------------------------- fingerprints

@register("op9_syncmer_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------- licences

@register("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.train(docs))
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_license_paragraphs"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.col("found.family")))).alias("families"),
        F.coalesce(F.get("found", F.lit(0))["place"], F.lit(-1)).cast("long").alias("first_line"),
        F.coalesce(F.array_max(F.col("found.probability")), F.lit(0.0)).alias("probability"),
        F.coalesce(F.array_max(F.col("found.share")), F.lit(0.0)).alias("template_share"))


# ---------------------------------------------------------------- collocations

_PHRASE_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
c1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM pieces) GROUP BY ALL),
c2 AS (SELECT lang, x[1] AS x, x[2] AS y, count(*) AS f
  FROM (SELECT lang, unnest([w[i:i+1] FOR i IN range(1, len(w))]) AS x FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
c3 AS (SELECT lang, x[1] AS x, x[2] AS y, x[3] AS z, count(*) AS f
  FROM (SELECT lang, unnest([w[i:i+2] FOR i IN range(1, len(w) - 1)]) AS x FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
s2 AS (SELECT c.*, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM c2 c JOIN c1 l ON l.lang = c.lang AND l.x = c.x JOIN c1 r ON r.lang = c.lang AND r.x = c.y),
t3 AS (SELECT c.*, l.f AS f1, xy.f AS f12, yz.f AS f23, r.f AS f3,
    CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(l.f AS HUGEINT) * yz.f) AS s1,
    CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(xy.f AS HUGEINT) * r.f) AS s2
  FROM c3 c JOIN c1 l ON l.lang = c.lang AND l.x = c.x JOIN c1 r ON r.lang = c.lang AND r.x = c.z
  JOIN c2 xy ON xy.lang = c.lang AND xy.x = c.x AND xy.y = c.y JOIN c2 yz ON yz.lang = c.lang AND yz.x = c.y AND yz.y = c.z),
longer AS (SELECT lang, x, y, max(f) AS f FROM (
    SELECT lang, x, y, f FROM c3 UNION ALL SELECT lang, y, z, f FROM c3) GROUP BY ALL),
kept AS (
  SELECT s.lang, s.x || ' ' || s.y AS phrase, s.f AS a, s.l, s.r, s.score FROM s2 s
  LEFT JOIN longer o ON o.lang = s.lang AND o.x = s.x AND o.y = s.y WHERE o.f IS NULL OR 100 * o.f < 50 * s.f
  UNION ALL
  SELECT lang, x || ' ' || y || ' ' || z, f, CASE WHEN s2 < s1 THEN f12 ELSE f1 END,
    CASE WHEN s2 < s1 THEN f3 ELSE f23 END, least(s1, s2) FROM t3),
n AS (SELECT lang, sum(f) AS n FROM c1 GROUP BY lang)
SELECT k.lang, row_number() OVER w AS rank, k.phrase, k.a, k.l, k.r, CAST(n.n AS BIGINT) AS n, CAST(k.score AS BIGINT) AS score
FROM kept k JOIN n ON n.lang = k.lang
WINDOW w AS (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase)
QUALIFY row_number() OVER w <= 2000"""


@register("op12_phrases", _PHRASE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


# -------------------------------------------------------------- hard negatives

_NEGATIVE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5"""


@register("op13_hard_negatives", _NEGATIVE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(
        F.col("label").isNotNull() & topk_search.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select(
        F.col("vec_id").alias("id"), label.alias("label"), topk_search.quantized(F.col("embedding")).alias("vector"),
        (F.col("vec_id") % 100 == 0).alias("anchor")))


# ------------------------------------------------------------------------ WARC

_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN CAST(first AS BIGINT) END AS refers_to
FROM f"""


@register("op11_capture_index", _WARC_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = capture_index.write_archive(pages)
    captures = capture_index.lookup(archive, capture_index.url_keys(pages))
    return capture_index.fetch(archive, captures, keep_payload=False).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")
