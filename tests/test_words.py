from collections import Counter

import numpy as np
import pytest

from agora.operators import words as W

TEXTS = ["red green blue red yellow", "green green red", None, "", "blue unknown unknown unknown red",
         "the red and the blue green yellow yellow red", "solo", "yellow blue yellow blue " * 700]
VOCAB = ["red", "green", "blue", "yellow", "solo"]


def plain_pairs(texts, window, stop=("the", "and")):
    out = Counter()
    for t in texts:
        toks = [x for x in (t or "").split() if x not in stop]
        for i, x in enumerate(toks):
            for y in toks[i + 1: i + 1 + window]:
                if x in VOCAB and y in VOCAB:
                    out[min(x, y), max(x, y)] += 1
    return out


def frames(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(v,) for v in [*VOCAB, "red", None]], "term string")


@pytest.mark.parametrize("window,step", [(1, 1 << 20), (3, 1 << 20), (3, 5)])
def test_pairs_by_definition(spark, monkeypatch, window, step):
    monkeypatch.setattr(W, "_TOKENS", step)
    docs, vocab = frames(spark)
    got = {(r.a, r.b): r.n for r in W.word_pairs(docs, vocab, window=window).collect()}
    assert got == dict(plain_pairs(TEXTS, window))


def matrix(pairs):
    names = sorted({x for p in pairs for x in p})
    c = np.zeros((len(names), len(names)))
    for (a, b), n in pairs.items():
        i, j = names.index(a), names.index(b)
        c[i, j] += n
        c[j, i] += n
    with np.errstate(divide="ignore"):
        return names, np.maximum(0, np.log(c * c.sum() / np.outer(c.sum(1), c.sum(1))))


def test_information_and_factors(spark):
    docs, vocab = frames(spark)
    pairs = W.word_pairs(docs, vocab, window=2)
    names, info = matrix(plain_pairs(TEXTS, 2))
    for r in W.positive_information(pairs).collect():
        assert r.information == pytest.approx(info[names.index(r.a), names.index(r.b)])
    got = {r.term: r.embedding for r in W.word_vectors(pairs, 2).collect()}
    x = np.array([got[n] for n in names])
    centred = info - info.mean(0)
    _, _, axes = np.linalg.svd(centred)
    want = info @ axes[:2].T
    for j in range(2):
        assert min(np.abs(x[:, j] - want[:, j]).max(), np.abs(x[:, j] + want[:, j]).max()) < 1e-5
    topic = W.word_topic_vectors(spark.createDataFrame([(0, "red", 1.0), (0, "blue", 3.0), (0, "none", 9.0)],
                                                       "topic int, term string, score double"),
                                 W.word_vectors(pairs, 2)).first().embedding
    assert np.allclose(topic, (np.array(got["red"]) + 3 * np.array(got["blue"])) / 4)


def test_no_pairs_and_too_many_terms(spark, monkeypatch):
    docs, vocab = frames(spark)
    none = W.word_pairs(docs.filter("doc_id = 6"), vocab)
    assert none.collect() == [] and W.word_vectors(none).collect() == []
    monkeypatch.setattr(W, "MAX_FEATURES", 3)
    with pytest.raises(ValueError):
        W.word_pairs(docs, vocab)
