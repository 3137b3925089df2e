"""The most frequent terms of groups in two passes, without shuffling rare ones.

The first pass keeps a bounded summary per task (Misra and Gries): when more than
``capacity`` (group, term) pairs are held, all lose the count of the pair behind the
last place, and those without a rest go. What was taken off, summed over the tasks,
bounds by how much any count is too low, so it tells which terms can be among a
group's first. The second pass counts those exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.constants import ENGLISH_STOP_WORDS
from agora.operators import terms as terms_ops
from agora.session import write_shared

#: Pairs of a task's summary: some ten megabytes.
CAPACITY = 200_000
#: Candidates that are sent to all tasks of the second pass; more are joined by a shuffle.
SENT = 500_000


def _summed(table: pa.Table, keys: list[str]) -> pa.Table:
    return table.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _pruned(table: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """At most ``capacity`` pairs, and the count that all of them lost."""
    if table.num_rows <= capacity:
        return table, 0
    n = table.column("n").to_numpy()
    off = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
    at = table.column_names.index("n")
    rest = table.set_column(at, "n", pc.subtract(table.column("n"), off))
    return rest.filter(pc.greater(rest.column("n"), 0)), off


def summary(counts: DataFrame, group_col: str, capacity: int) -> DataFrame:
    """``(group, term, n, off)``: each task's pairs of ``(group, term, n)`` with counts
    that are too low by at most the task's ``off``, which stands in a row of its own."""
    keys = [group_col, "term"]
    kind = counts.schema[group_col].dataType.simpleString()

    def run(batches):
        held, off = None, 0
        for b in batches:
            new = pa.Table.from_batches([b]).select([*keys, "n"])
            held = _summed(new if held is None else pa.concat_tables([held, new]), keys)
            if held.num_rows > 2 * capacity:
                held, less = _pruned(held, capacity)
                off += less
        if held is None:
            return
        held, less = _pruned(held, capacity)
        held = held.append_column("off", pa.nulls(held.num_rows, pa.int64()))
        yield from held.combine_chunks().to_batches(max_chunksize=10_000)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, held.schema.field(group_col).type), pa.nulls(1, pa.string()),
                                          pa.nulls(1, pa.int64()), pa.array([off + less])], names=held.column_names)

    return counts.select(*keys, "n").mapInArrow(run, f"`{group_col}` {kind}, term string, n bigint, off bigint")


def frequent_terms(docs: DataFrame, group_col: str, k: int, text_col: str = "text", min_n: int = 1, max_n: int = 1,
                   stop_words=ENGLISH_STOP_WORDS, capacity: int = CAPACITY) -> DataFrame:
    """``(group, rank, term, n)``: the ``k`` most frequent n-grams of each group (all,
    if there are fewer), ties by term; the same rows as a full count.

    A group is settled if its k-th count in the summary is above the summaries' whole
    error: then a term that no summary holds can't be among its first k. Groups that
    are not settled (flat counts, or fewer than k terms) are counted in full. Null
    groups and null texts take no part."""
    keys = [group_col, "term"]
    batches = terms_ops.batch_group_terms(docs, group_col, text_col, min_n, max_n, stop_words)
    held = write_shared(summary(batches, group_col, capacity), "summaries")
    error = held.agg(F.coalesce(F.sum("off"), F.lit(0))).first()[0]
    low = held.filter("term is not null").groupBy(*keys).agg(F.sum("n").alias("n"))
    if error == 0:  # nothing was taken off: the summaries are the counts
        exact = low
    else:
        low = write_shared(low, "low")
        place = F.row_number().over(Window.partitionBy(group_col).orderBy(F.desc("n"), "term"))
        kth = low.withColumn("place", place).filter(F.col("place") <= k).groupBy(group_col).agg(
            F.max("place").alias("places"), F.min("n").alias("floor"))
        settled = write_shared(kth.filter((F.col("places") == k) & (F.col("floor") > error)).drop("places"), "settled")
        candidates = write_shared(low.join(settled, group_col).filter(F.col("n") + error >= F.col("floor")).select(*keys), "candidates")
        few = candidates.count() <= SENT
        counted = batches.join(F.broadcast(candidates) if few else candidates, keys, "left_semi")
        full = docs.filter(F.col(group_col).isNotNull()).join(settled.select(group_col), group_col, "left_anti")
        rest = terms_ops.batch_group_terms(full, group_col, text_col, min_n, max_n, stop_words)
        exact = counted.unionByName(rest).groupBy(*keys).agg(F.sum("n").alias("n"))
    return terms_ops.top_n_per_group(exact, group_col, "n", k).select(group_col, "rank", "term", "n")
