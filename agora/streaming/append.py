"""Incremental embedding (A5) with Structured Streaming.

New files landing in ``src_dir`` are embedded micro-batch by micro-batch
and appended to ``dst_dir``. The stream checkpoint records which files were
processed, so a restart never re-embeds them; each micro-batch writes its
own ``batch_id`` partition with dynamic overwrite, so a batch replayed after
a failure replaces its partial output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators.embed import embed_column


def append_embeddings(spark: SparkSession, src_dir: str, dst_dir: str, checkpoint: str,
                      schema: T.StructType | str, text_col: str = "text",
                      embedder=None, dim: int = 64, max_files_per_trigger: int | None = None,
                      available_now: bool = True):
    """Run (or, with ``available_now``, drain) the embedding stream; returns
    the StreamingQuery."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(src_dir)

    def write_batch(batch, batch_id: int):
        out = embed_column(batch, text_col, embedder, dim=dim).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(dst_dir))

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
