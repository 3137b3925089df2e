"""Sources and sinks."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_CSV_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("cleaned_title", T.StringType()),
])


def read_docs(spark: SparkSession, path: str, fmt: str = "parquet",
              schema: T.StructType | str | None = None) -> DataFrame:
    """A1: header CSV (free text with quotes, commas, newlines) or parquet.
    CSV is read with an explicit schema — no inference pass. Cells may hold
    newlines, so a CSV file is read by one task: keep large corpora as Parquet,
    or as many CSV files."""
    if fmt == "csv":
        return (spark.read.schema(schema or DOC_CSV_SCHEMA)
                .option("header", True).option("multiLine", True)
                .option("quote", '"').option("escape", '"')
                .csv(path))
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(path)


def read_batches(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A2: many batch files as one dataset; the originating file is kept
    so batches can be rewritten, and rows are aligned by ``id`` (never by
    position)."""
    if isinstance(paths, str):
        paths = [paths]
    return spark.read.parquet(*paths).withColumn("source_file", F.col("_metadata.file_path"))


def read_manifest(spark: SparkSession, entries: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """A2 in the manifest's order: Parquet batches (files, or folders of files) with
    ``batch`` (the entry's place in ``entries``), ``file`` (the file's place in its
    entry, by name) and ``row`` (the row's place in its file). Ordered by these
    three, the rows stand as the batches read one after another; nothing is sorted
    unless a caller asks for it.

    An entry that is listed twice gives its rows twice; a missing one raises.
    Without entries (then ``schema`` is needed) the table is empty. The files are
    scanned in parallel, with filters and columns pushed down; their places, a row
    per file, join by path, as a broadcast only while the table is below Spark's
    threshold. Columns of the batches with those three names are replaced."""
    own = ["batch", "file", "row"]
    if not entries:
        return spark.createDataFrame([], schema).drop(*own).select(
            "*", *(F.lit(0).cast("bigint").alias(c) for c in own))
    listed = {e: sorted(spark.read.parquet(e).inputFiles()) for e in dict.fromkeys(entries)}
    plain = lambda path: re.sub("^file:/+", "file:/", path)  # noqa: E731  (local paths are spelt in two ways)
    places = [(plain(path), batch, file) for batch, e in enumerate(entries) for file, path in enumerate(listed[e])]
    table = spark.createDataFrame(places, "__path string, batch bigint, file bigint")
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(*listed)  # each entry once
    rows = rows.select(*(c for c in rows.columns if c not in own), F.col("_metadata.row_index").alias("row"),
                       F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("__path"))
    return rows.join(table, "__path").drop("__path").select(
        *(c for c in rows.columns if c not in ("row", "__path")), *own)


def read_vectors(spark: SparkSession, path: str, id_col: str = "doc_id",
                 vec_col: str = "embedding") -> DataFrame:
    """A3: one parallel scan of a vector table (no offset paging)."""
    return spark.read.parquet(path).select(id_col, vec_col)


def vector_stats(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Count and dimension range of a vector table (the paging loop's
    bookkeeping as one aggregate)."""
    return vectors.agg(F.count(F.lit(1)).alias("n"),
                       F.min(F.size(vec_col)).cast("bigint").alias("dim_min"),
                       F.max(F.size(vec_col)).cast("bigint").alias("dim_max"))


def _csv_safe(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """A4: overwrite a table; CSV gets a header and JSON text for nested
    columns."""
    w = (_csv_safe(df) if fmt == "csv" else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def cluster_report(top_terms: DataFrame) -> DataFrame:
    """A7 body: one text block per cluster — ``Cluster k:`` then one
    ``term: score`` line per rank (best first)."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term", "score"))),
        lambda s: F.concat(s["term"], F.lit(": "), F.format_number(s["score"], 6)))
    return (top_terms.groupBy("cluster")
            .agg(F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(":\n"),
                          F.array_join(lines, "\n")).alias("report")))


def write_cluster_report(top_terms: DataFrame, path: str) -> None:
    """The report as text files (one block per line group)."""
    cluster_report(top_terms).orderBy("cluster").select("report").write.mode("overwrite").text(path)


MODEL_PARTS = ("ctfidf", "topic_terms", "topic_vectors", "doc_topics", "topic_info", "settings")


def save_topic_model(model: dict[str, DataFrame], path: str) -> None:
    """A topic model is a directory of parquet tables: the whole c-TF-IDF, words,
    vectors, documents, the topic table and the settings."""
    for name in MODEL_PARTS:
        if name in model and model[name] is not None:
            model[name].write.mode("overwrite").parquet(os.path.join(path, name))


def load_topic_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All parts of a saved model; a part that is missing raises."""
    return {name: spark.read.parquet(os.path.join(path, name)) for name in MODEL_PARTS}


def attach_labels(chunks: DataFrame, labels: DataFrame, key: str = "umap_cluster",
                  id_col: str = "id", label_col: str = "cluster") -> DataFrame:
    """A6 plan: chunk metadata with the cluster label set under ``key``
    (joined on ``id``; chunks without a label keep their metadata)."""
    from agora.functions.maps import metadata_set
    j = chunks.join(labels.select(id_col, label_col), id_col, "left")
    return j.withColumn("metadata", F.when(F.col(label_col).isNull(), F.col("metadata"))
                        .otherwise(metadata_set("metadata", key, F.col(label_col)))).drop(label_col)


def write_back_labels(chunks: DataFrame, labels: DataFrame, path: str,
                      key: str = "umap_cluster", batch_col: str = "batch") -> None:
    """Rewrite the labelled chunks, one directory per batch, into a new
    version directory (dynamic partition overwrite)."""
    (attach_labels(chunks, labels, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(batch_col).parquet(path))
