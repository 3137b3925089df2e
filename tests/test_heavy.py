from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from agora.operators import heavy as H
from agora.operators import terms


def _docs(spark, flat=False, n=240, seed=5):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 401) ** (0.0 if flat else 1.3)
    rows = []
    for i in range(n):
        ids = rng.choice(400, size=40, p=p / p.sum())
        group = "hot" if i % 3 else f"g{i % 4}"
        rows.append((i, group if i % 20 else None, " ".join(f"w{x:03d}" for x in ids) if i % 17 else None))
    rows.append((9999, "tiny", "alpha beta alpha"))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)


def _plain(rows, k, n):
    counts = {}
    for _, group, text in rows:
        if group is not None and text:
            t = text.split()
            counts.setdefault(group, Counter()).update(" ".join(t[i:i + n]) for i in range(len(t) - n + 1))
    return {(g, r + 1): (t, c) for g, count in counts.items()
            for r, (t, c) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:k])}


@pytest.mark.parametrize("flat,n,capacity", [(False, 1, 150), (False, 2, 300), (True, 1, 150), (False, 1, 10**6), (False, 1, 1)])
def test_same_rows_as_a_full_count(spark, flat, n, capacity):
    rows, docs = _docs(spark, flat)
    out = H.frequent_terms(docs, "source", 5, min_n=n, max_n=n, stop_words=(), capacity=capacity).collect()
    assert {(r.source, r["rank"]): (r.term, r.n) for r in out} == _plain(rows, 5, n)


def test_summary_bounds_every_count(spark):
    rows, docs = _docs(spark)
    counts = terms.batch_group_terms(docs, "source", stop_words=())
    held = H.summary(counts, "source", 60).collect()
    error = sum(r.off or 0 for r in held)
    low = Counter()
    for r in held:
        if r.term is not None:
            low[r.source, r.term] += r.n
    true = {(r.source, r.term): r.n for r in counts.groupBy("source", "term").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert error > 0 and len(low) < len(true)
    assert all(low[p] <= n <= low[p] + error for p, n in true.items())


def test_pruning_keeps_the_capacity():
    t = pa.table({"g": ["a"] * 6, "term": list("uvwxyz"), "n": [9, 7, 5, 5, 2, 1]})
    kept, off = H._pruned(t, 3)
    assert off == 5 and kept.to_pylist() == [{"g": "a", "term": "u", "n": 4}, {"g": "a", "term": "v", "n": 2}]
    assert H._pruned(t, 6) == (t, 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert H.frequent_terms(empty, "source", 3).collect() == []
