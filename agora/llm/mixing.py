"""Mix sources to target weights by hash-threshold histograms.

Every row has a hash that depends only on its content. For each source the sizes
are summed by hash bucket; the bucket in which the running sum passes the budget
is refined by the next hash bits, and so on, until one hash value is left. A
source's rows below its threshold are taken: a filter, no sort of rows, and no
group ever holds more than its 4,096 bucket sums. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agora.llm.common import word_count
from agora.session import write_shared

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
HASH_BITS, LEVEL_BITS = 60, 12


def row_hash(key: str, text: str, seed: int = 0) -> Column:
    """60 bits from the md5 of id and text: a function of content, so reruns agree."""
    whole = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"),
                           F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))).cast("binary"))
    return F.conv(F.substring(whole, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most: int = MOST_REPEATS) -> DataFrame:
    """``(source, source_size)`` plus ``target``: sources by code point, null
    last, weigh ``weights`` over and over; they share the sum of all sizes, and
    what lies above ``most`` times a source's size is reshared by weight.

    In the limit of resharing, target = min(cap, share * weight) for one common
    share. The capped sources are the first ones by cap / weight, so running sums
    give the share. One row per source goes through the two windows."""
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    cap = F.col("source_size") * F.lit(float(most))
    s = sizes.withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # with the k smallest capped, the rest would get left / free per weight; the
    # first source that this share does not fill ends the capped ones
    s = s.withColumn("share", left / free).withColumn(
        "fits", F.col("cap") >= F.col("share") * F.col("weight"))
    share = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(),
                                                 "source", "share"))).over(every)["share"]
    return s.select("source", "source_size",
                    F.coalesce(F.least("cap", share * F.col("weight")), F.col("cap")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(source, below)``: rows of a source with ``hash < below`` sum up to its
    budget as nearly as whole rows allow (the row or tie group at the boundary
    is taken if at least half of it fits).

    ``rows``: ``(source, size, hash)``; ``budgets``: ``(source, budget)``, one row
    per source, each budget less than the source's size."""
    open_ = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        here = (rows.join(open_.select(F.col("source").alias("s"), F.col("prefix").alias("p")),
                          F.col("source").eqNullSafe(F.col("s"))
                          & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("p")))
                if shift + LEVEL_BITS < HASH_BITS else rows)
        histogram = (here.groupBy("source", F.shiftright("hash", shift).alias("bucket"))
                     .agg(F.sum("size").alias("words")))
        running = W.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("words").over(running)).withColumnRenamed("source", "s")
        over = (histogram.join(open_.select("source", "left"), F.col("source").eqNullSafe(F.col("s")))
                .filter(F.col("upto") > F.col("left"))
                .groupBy("source", "left")
                .agg(F.min(F.struct("bucket", "words", "upto")).alias("b")))
        open_ = write_shared(over.select(
            "source", (F.col("left") - (F.col("b.upto") - F.col("b.words"))).alias("left"),
            F.col("b.bucket").alias("prefix"), F.col("b.words").alias("words")), "boundary")
    fits = F.col("left") * 2 >= F.col("words")
    return open_.select("source", (F.col("prefix") + fits.cast("long")).alias("below"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``(s, source_size, target, full, below)``: per source, how often all rows
    are taken, and the hash below which a row is taken once more."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most)
    targets = write_shared(targets.withColumn(
        "full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long")), "targets")
    budgets = targets.select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))
    return (targets.join(thresholds(rows, budgets).withColumnRenamed("source", "s"),
                         F.col("source").eqNullSafe(F.col("s")), "left")
            .select(F.col("source").alias("s"), "source_size", "target", "full",
                    F.coalesce("below", F.lit(0)).alias("below")))


def _sizes(documents: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return write_shared(documents.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"), row_hash(key, text, seed).alias("hash")), "sizes")


def _repeats() -> Column:
    return F.col("full") + (F.col("hash") < F.col("below")).cast("long")


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """Repeats of each row in a mix in which every source meets its target.

    A source whose target is q times its size plus a rest takes every row q
    times, and one time more the rows below its hash threshold. Returns one row
    per input row: ``key, source, hash, size, source_size, target, repeats,
    taken`` (= repeats * size, never above ``most`` * size).

    Null text counts no words; a null source is a source of its own; rows with
    equal id and text share a hash and are taken alike; an empty table gives an
    empty table. Other columns are ignored. A source without words takes nothing.
    """
    rows = _sizes(documents, key, text, source, seed)
    plan = _plan(rows, weights, most)
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("repeats", _repeats())
            .select(F.col("key").alias(key), "source", "hash", "size", "source_size", "target",
                    "repeats", (F.col("repeats") * F.col("size")).alias("taken")))


def mixed(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as :func:`mix` takes it.
    The rows are not shuffled: a source's threshold comes to them by a join with
    the table of sources."""
    plan = _plan(_sizes(documents, key, text, source, seed), weights, most)
    names = ["__source", "__hash", "__copies"]
    rows = documents.withColumn("__source", F.col(source).cast("string")).withColumn(
        "__hash", row_hash(key, text, seed))
    p = plan.select(F.col("s").alias("__s"), F.col("full").alias("__full"), F.col("below").alias("__below"))
    copies = (F.col("__full") + (F.col("__hash") < F.col("__below")).cast("long")).cast("int")
    return (rows.join(p, F.col("__source").eqNullSafe(F.col("__s")))
            .withColumn("__copies", F.explode(F.sequence(F.lit(0), copies)))
            .filter("__copies > 0").drop(*names, "__s", "__full", "__below"))
