"""Map the generated test tables onto the canonical schemas.

Each function reads whole tables; the same derivations are written as SQL
in ``__spark_entry__.py`` for the oracle.

    docs     : doc_id, text, clean_text, lang, source
    clusters : doc_id, cluster            (-1 = noise)
    vectors  : doc_id, embedding array<float>
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus; ``clean_text`` is NULL for every 7th id so the
    clean-else-raw coalesce is observable."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text",
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("clean_text"),
        "lang", "source")


def source_cluster():
    """Given document class: the number in ``source`` (src0 → noise −1)."""
    n = F.regexp_extract(F.col("source"), r"(\d+)", 1).cast("int")
    return F.when(n == 0, F.lit(-1)).otherwise(n)


def source_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", source_cluster().alias("cluster"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding"))


def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given labels of the vector table (label 9 → noise −1)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).alias("cluster"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding",
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).alias("cluster"))


def web_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as titled documents: ``domain`` from the URL host, ``title``
    from ``<title>``; ``cleaned_title`` trims/collapses it (NULL if empty)."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract(F.col("html"), r"(?s)<title>(.*?)</title>", 1)
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    return p.select(
        F.col("page_id").alias("doc_id"),
        F.regexp_extract(F.col("url"), r"^[A-Za-z]+://([^/:?#]+)", 1).alias("domain"),
        F.when(title == "", F.lit(None).cast("string")).otherwise(title).alias("title"),
        F.when(cleaned == "", F.lit(None).cast("string")).otherwise(cleaned).alias("cleaned_title"),
        F.col("html").alias("text"))


def category_queries(spark: SparkSession) -> DataFrame:
    """The six fixed category queries (a parameter table, not data)."""
    from agora.functions.constants import CATEGORY_QUERIES
    return spark.createDataFrame(list(CATEGORY_QUERIES), "category string, query string")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query/keyword texts from the ``benchmark`` table."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks ("idea units"): id, document, metadata map, batch."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("document"),
        F.create_map(F.lit("source_index_col"), F.col("conv_id").cast("string"),
                     F.lit("idea_unit_index"), F.col("turn").cast("string"),
                     F.lit("role"), F.col("role")).alias("metadata"),
        (F.col("conv_id") % 4).alias("batch"))
