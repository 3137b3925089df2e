"""Corpus pipeline: documents -> quality -> language -> near duplicates -> mix -> packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``. All but the last return the
columns of ``documents``; a row that the mix repeats appears as often as it is
taken, and the packing stage packs every repeat.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import jaccard_join, lang_id, mixing, packing, quality_gbt
from agora.llm.common import fold, table
from agora.session import write_shared


def _judged(docs: DataFrame, added: list[str], judge, keep) -> DataFrame:
    """The rows that ``keep`` of the columns that ``judge`` adds; columns of
    ``docs`` with the same names step aside meanwhile."""
    aside = {c: f"__own_{c}" for c in added if c in docs.columns}
    back = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return judge(docs.withColumnsRenamed(aside)).filter(keep).select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, predicts good."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    forest = quality_gbt.train(docs, labels)
    return _judged(docs, ["score", "predicted"], lambda d: quality_gbt.score(d, forest), F.col("predicted") == 1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt; those without a letter or with no
    more likeness to a language than unrelated texts have go."""
    known = docs.filter(F.col("lang").isNotNull() & (fold("doc_id", 3) != 1))
    profiles = lang_id.profiles(known, "text", "lang")
    return _judged(docs, ["score", "lang_pred", "lang_known"], lambda d: lang_id.identify(d, profiles), F.col("lang_known"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest ``doc_id``, then text
    hash; a row without an id comes last. Rows are told apart by a number of their
    own, written once, so different texts under one id all stay."""
    rows = write_shared(docs.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "__id")
    kept = (jaccard_join.join(rows, "__id", "text").select("__id", "component_id")
            .join(rows.select("__id", order.alias("order")), "__id")
            .groupBy("component_id").agg(F.min("order").alias("order")).select("order.__id"))
    return rows.join(kept, "__id", "left_semi").drop("__id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates),
          ("mix", mix), ("pack", pack)]

#: The classifiers, the similarity join and the tokenizer have no SQL form; the
#: pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
