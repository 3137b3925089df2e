"""Frequent n-grams by a table of hashed counts, against plain counts."""

from collections import Counter, defaultdict

import pytest

from agora.operators import tally, terms


def _lists(n_docs=120):
    """Group a has frequent words among rare ones, b is flat, c has few terms."""
    rows = []
    for i in range(n_docs):
        rows.append(("a", [f"hot{j}" for j in range(40) for _ in range(j % 3 + 1)] + [f"a{i}x{j}" for j in range(20)]))
        rows.append(("b", [f"b{i}x{j}" for j in range(10)]))
    return [*rows, ("c", ["one", "two", "one"]), ("c", None), ("d", []), (None, ["lost", "lost"])]


def _plain(rows, min_n, max_n):
    total, docs = defaultdict(Counter), defaultdict(Counter)
    for group, words in rows:
        words = words or []
        grams = [" ".join(words[i: i + n]) for n in range(min_n, max_n + 1) for i in range(len(words) - n + 1)]
        total[group].update(grams)
        docs[group].update(set(grams))
    return total, docs


@pytest.mark.parametrize("min_n,max_n,places", [(1, 1, 1 << 16), (1, 2, 1 << 10), (2, 3, 64), (2, 2, 1)])
def test_frequent(spark, min_n, max_n, places):
    rows = _lists()
    k = 5
    df = spark.createDataFrame(rows, "g string, terms array<string>").repartition(5)
    got = tally.frequent(df, "g", k, min_n, max_n, places).collect()
    total, docs = _plain(rows, min_n, max_n)
    found = defaultdict(dict)
    for r in got:
        assert r["term"] not in found[r["g"]]
        found[r["g"]][r["term"]] = r["n"]
        assert (r["n"], r["df"]) == (total[r["g"]][r["term"]], docs[r["g"]][r["term"]])
    assert set(found) <= {"a", "b", "c"}
    first = lambda counts: sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    for g in "abc":
        assert first(found[g]) == first(total[g])
    if places == 1 << 16:  # rare ones of a stay out
        assert len(found["a"]) < 100 < len(total["a"])


def test_many_groups_are_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(tally, "MOST_GROUPS", 2)
    rows = _lists(10)
    df = spark.createDataFrame(rows, "g string, terms array<string>")
    got = {(r["g"], r["term"]): (r["n"], r["df"]) for r in tally.frequent(df, "g", 1, 2, 2).collect()}
    total, docs = _plain([r for r in rows if r[0]], 2, 2)
    assert got == {(g, t): (n, docs[g][t]) for g, c in total.items() for t, n in c.items()}


def _bigram_input(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(["alpha beta"] * (i % 5 + 1) + [f"rare{i}x{j}" for j in range(30)]), i % 4 - 1) for i in range(80)]
        + [(99, None, 1), (99, "alpha beta", None)], "doc_id long, text string, cluster int")
    topics = spark.createDataFrame([(0, 5), (1, 6), (2, 7), (-1, -1)], "cluster int, topic int")
    groups = spark.createDataFrame([("x", 5), ("x", 6), ("y", 6), ("y", 6), ("z", -1)], "group string, topic int")
    return docs, topics, groups


def test_group_bigrams_by_both_ways(spark, monkeypatch):
    docs, topics, groups = _bigram_input(spark)
    short = sorted(map(tuple, terms.group_top_bigrams(docs, topics, groups, top_n=3).collect()))
    monkeypatch.setattr(terms, "SENT_TOPICS", 0)
    assert short == sorted(map(tuple, terms.group_top_bigrams(docs, topics, groups, top_n=3).collect()))
    n = {c: sum(i % 5 + 1 for i in range(80) if i % 4 - 1 == c) for c in (0, 1)}
    assert [r for r in short if r[1] == 1] == [("x", 1, "alpha beta", n[0] + n[1]), ("y", 1, "alpha beta", 2 * n[1])]


def test_rare_bigrams_are_not_shuffled(spark, monkeypatch):
    """Neither the groups' bigrams nor the corpus' terms are all counted by term."""
    def no(*a, **b):
        raise AssertionError("counts everything")
    monkeypatch.setattr(terms, "count_group_terms", no)
    monkeypatch.setattr(terms, "count_terms", no)
    docs, topics, groups = _bigram_input(spark)
    assert terms.group_top_bigrams(docs, topics, groups, top_n=1).count() == 2
    assert terms.corpus_tfidf(docs, max_features=10).count() > 0
