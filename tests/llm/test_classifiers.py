"""Language, quality, licences and language-model scores."""
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agora.llm import lang_id, license_scan, maxent_lm, quality_gbt
from agora.llm.common import fold, table, texts_of
from agora.session import write_shared
from tests.llm.helpers import DE, EN, FR, awkward, empty, lower, words

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_words():
    texts = ["a  B", "", None, " b\n\nA", "x\x0by\x1cz é", "longword" * 2000]
    hashes, first = texts_of(pa.array(texts)).word_hashes(step=16)
    split = [words(lower(t)) for t in texts]
    assert np.diff(first).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    by_word = {}
    for w, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_fold_is_crc32_of_text(spark):
    rows = spark.range(50).select("id", fold("id", 3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)


# ---------------------------------------------------------------- language

def test_bundle_is_sum_of_bound_trigrams():
    """Against the definition, one n-gram at a time."""
    text = "Ab, ba é"
    t = lang_id.Trigrams([text])
    line = []
    for ch in f" {text.lower()} ":
        c = ord(ch) if ch.isalpha() else 0
        if c or not line or line[-1]:
            line.append(c)
    v = {c: lang_id.letter_vectors(np.array([c]))[0] for c in set(line)}
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(line, line[1:], line[2:]))
    assert np.allclose(t.bundles()[0], want)


def test_language_edge_cases(spark):
    docs = awkward(spark)
    known = lang_id.profiles(docs.filter("lang in ('en', 'de', 'fr')"), "text", "lang")
    out = lang_id.identify(docs, known)
    assert out.columns.count("score") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count()
    for i in (5, 6, 7, 8):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[3]["lang_pred"] == "de" and got[4]["lang_pred"] == "fr" and got[1]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    none = lang_id.profiles(empty(spark), "text", "lang")
    assert none.count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(docs, none).collect()} == {"und"}
    assert lang_id.identify(empty(spark), known).count() == 0


def test_unseen_languages_are_rejected(spark):
    """Texts of unseen scripts and random letters go, short clean ones stay."""
    import corpus_pipeline
    rng = np.random.default_rng(7)
    made = lambda letters: " ".join(
        "".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(40))
    alphabets = ["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыьэюя", "אבגדהוזחטיכלמנסעפצקרשת",
                 "abcdefghijklmnopqrstuvwxyz"]
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    clean = [r["text"][:100] for r in docs.filter(
        (fold("doc_id", 3) == 1) & F.col("lang").isNotNull() & (F.length("text") > 100)).collect()]
    rows = ([(10**6 + i, made(a), None) for i, a in enumerate(alphabets * 50)]
            + [(2 * 10**6 + i, t, None) for i, t in enumerate(clean)])
    stage = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    kept = {r["doc_id"] for r in stage.filter("doc_id >= 1000000").collect()}
    foreign = [i for i, _, _ in rows if i < 2 * 10**6 and i in kept]
    assert len(foreign) <= 0.02 * 200
    assert len(kept) - len(foreign) >= 0.95 * len(clean) > 20
    known = lang_id.profiles(docs.filter("lang is not null"), "text", "lang")
    said = lang_id.identify(spark.createDataFrame(rows[:200], docs.schema), known).collect()
    assert sum(not r["lang_known"] for r in said) >= 0.98 * 200 and any(r["score"] > 0 for r in said)
    assert all(r["lang_pred"] != "und" for r in said)


def test_every_text_with_a_letter_has_a_language(spark):
    """The whole query against one bundle per text, built letter by letter."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    short = [(10**6 + i, t, None) for i, t in enumerate(["a", "Yes.", "é", "1 x", "?!", "", None, "ab", "日"])]
    rows = [tuple(r) for r in docs[:60]] + short
    known = lang_id.profiles(spark.createDataFrame(docs).filter("lang is not null"), "text", "lang")
    proto = {r["lang"]: np.array(r["prototype"]) for r in known.collect()}
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in lang_id.identify(made, known).collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        line = []
        for ch in f" {text.lower()} ":
            c = ord(ch) if ch.isalpha() else 0
            if c or not line or line[-1]:
                line.append(c)
        v = {c: lang_id.letter_vectors(np.array([c]))[0].astype(float) for c in set(line)}
        bundle = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(line, line[1:], line[2:]))
        cosine = {name: bundle @ p / np.linalg.norm(bundle) / np.linalg.norm(p) for name, p in proto.items()}
        best = max(cosine, key=cosine.get)
        assert r["lang_pred"] == best and abs(r["score"] - max(0.0, cosine[best])) < 1e-4


def test_language_held_out_accuracy(spark):
    from agora.llm.queries import QUERIES
    out = QUERIES["op1_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


# ----------------------------------------------------------------- quality

def test_trees_learn_and_match_slow_traversal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality_gbt.fit(x, y, trees=20)
    p = forest.score(x)
    assert ((p >= 0.5) == y).mean() > 0.95

    def slow(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > t[i])
            total += leaf[i - len(f)]
        return 1 / (1 + np.exp(-total))
    assert np.allclose([slow(r) for r in x[:40]], p[:40])
    none = quality_gbt.fit(np.empty((0, 5), np.float32), np.empty(0))
    assert np.allclose(none.score(x[:3]), 0.5)
    assert quality_gbt.fit(x, np.ones(600)).score(x[:2]).min() > 0.99


def test_quality_edge_cases(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (3, 1), (8, 0), (None, 0), (4, None), (6, 0)], "doc_id long, quality int")
    forest = quality_gbt.train(docs, labels)
    out = quality_gbt.score(docs, forest).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in out)
    empty_scores = {r["score"] for r in out if r["text"] in (None, "")}
    assert len(empty_scores) == 1
    assert quality_gbt.score(empty(spark), forest).count() == 0
    unfitted = quality_gbt.train(empty(spark), labels)
    assert quality_gbt.score(docs, unfitted).filter("score = 0.5").count() == docs.count()


def test_quality_held_out(spark):
    from agora.llm.queries import QUERIES
    out = QUERIES["op4_quality_gbt"](spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95


# ---------------------------------------------------------------- licences

@pytest.fixture(scope="module")
def scanner(spark):
    return license_scan.train(table(spark, SF, "documents"))


def test_license_lines(spark, scanner):
    texts = {
        1: "Some prose here.\nReleased under the MIT License.\nMore prose.",
        2: "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.",
        3: "He lost his driving license in the public park.", 4: None, 5: "", 6: "\n\n",
        7: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
           "compliance with the License.",
        8: "released UNDER the mit license!", 9: EN + "\n" + DE,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("place", F.lit("clash"))
    out = {r["doc_id"]: r for r in license_scan.scan(docs, scanner).collect()}
    families = {i: [f["family"] for f in r["found"]] for i, r in out.items()}
    assert families == {1: ["MIT"], 2: ["CC-BY-NC-4.0", "GPL-3.0"], 3: [], 4: [], 5: [], 6: [],
                        7: ["Apache-2.0"], 8: ["MIT"], 9: []}
    assert out[1]["n_paragraphs"] == 3 and out[6]["n_paragraphs"] == 0
    assert out[1]["found"][0]["place"] == 1


def test_license_lines_with_several_and_with_names(spark, scanner):
    texts = {
        1: ("MIT License or Apache License, Version 2.0", {"MIT", "Apache-2.0"}),
        2: ("This project is dual-licensed under the MIT License or the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
        3: ("Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License, "
            "version 3.", {"Apache-2.0", "GPL-3.0"}),
        4: ("SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}),
        5: ("License: MIT", {"MIT"}),
        6: ("You should have received a copy of the license along with the program of the concert.", set()),
        7: ("SPDX-License-Identifier: Zlib", set()),
        8: ("He and she got the license at the office or at the station. The library is public.", set()),
        9: ("Some words first. " * 50 + "Released under the BSD 3-Clause License. " + "Some words after. " * 50, {"BSD"}),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    out = {r["doc_id"]: [f["family"] for f in r["found"]] for r in license_scan.scan(docs, scanner).collect()}
    assert {i: set(f) for i, f in out.items()} == {i: w for i, (_, w) in texts.items()}
    assert all(len(f) == len(set(f)) for f in out.values())


def test_license_edges(spark, scanner):
    docs = awkward(spark)
    assert license_scan.scan(docs, scanner).count() == docs.count()
    assert license_scan.scan(empty(spark), scanner).count() == 0
    license_scan.train(empty(spark))


def test_license_against_plain_search(spark):
    from agora.llm.queries import QUERIES
    out = QUERIES["op10_license_scan"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "text"), "doc_id")
    notices = ["GNU General Public License, version 3", "MIT License", "CC BY-NC 4.0", "Apache License, Version 2.0"]
    has = F.lit(False)
    for n in notices:
        has = has | F.col("text").contains(n)
    assert out.filter((F.col("families") != "") != has).count() == 0


# ------------------------------------------------------------ model scores

def _brute(rows):
    split = {i: words(lower(t)) + ["\n"] for i, t, _ in rows}
    c = Counter(w for i, _, tr in rows if tr for w in split[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(s), sum(c[w] > 0 for w in s), n, sum(np.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in s))
            for i, s in split.items()}


@pytest.mark.parametrize("head", [3, 1 << 17])
def test_base_scores_are_exact(spark, head):
    docs = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("train", F.col("doc_id") % 3 != 0)
    want = _brute([(r["doc_id"], r["text"], r["train"]) for r in docs.collect()])
    out = maxent_lm.score(docs, head=head).collect()
    assert len(out) == len(want)
    for r in out:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0


def test_class_probabilities_sum_to_one_and_learn(spark):
    docs = table(spark, SF, "documents").withColumn("train", fold("doc_id", 5) != 1)
    out = maxent_lm.score(docs).join(docs.select("doc_id", "train"), "doc_id")
    held = out.filter("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    model = maxent_lm.ClassModel(np.array([5, 9]), np.random.default_rng(1).normal(
        size=(maxent_lm.FEATURES, maxent_lm.BUCKETS, 4)).astype(np.float32), np.zeros(4, np.float32))
    f = np.random.default_rng(2).integers(0, maxent_lm.BUCKETS, (maxent_lm.FEATURES, 50))
    assert np.allclose(np.exp(model.log_p(f)).sum(axis=1), 1, atol=1e-5)


def _followers(spark, n, related=True):
    """Texts in which, if related, every word has one of two words of its own after it."""
    rng = np.random.default_rng(5)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400)]
    after = rng.integers(0, 400, (400, 2))
    texts = []
    for _ in range(n):
        w = [int(rng.integers(0, 400))]
        for _ in range(60):
            w.append(int(after[w[-1], rng.integers(0, 2)]) if related else int(rng.integers(0, 400)))
        texts.append(" ".join(names[i] for i in w))
    return spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")


def _pieces(docs, rounds=0):
    """The class model, vocabulary, rooms, head and training texts that score makes."""
    vocab = write_shared(maxent_lm.vocabulary(docs), "vocabulary")
    rows = vocab.toPandas()
    words_ = rows[rows.prefix >= 0]
    edges = maxent_lm._edges(words_.prefix.to_numpy(), words_.n_train.to_numpy(), 4)
    totals = maxent_lm._class_totals(vocab, edges)
    model = maxent_lm.ClassModel(edges, np.zeros((maxent_lm.FEATURES, maxent_lm.BUCKETS, len(totals)), np.float32),
                                 np.zeros(len(totals), np.float32))
    if rounds:
        model = maxent_lm.train(docs.filter("train").select("text"), edges, totals[:, 0], rounds)
    training = docs.filter("train").select("text", (F.col("doc_id") % 8 == 1).alias("dev"))
    h = np.sort(rows.hash.to_numpy().view(np.uint64))[::2].copy()  # every second word is outside the head
    n = dict(zip(rows.hash.to_numpy().view(np.uint64).tolist(), rows.n_train))
    head = maxent_lm.Head(h, np.array([n[x] for x in h.tolist()], np.int64))
    return vocab, model, np.log10(totals[:, 0] + 0.5 * (totals[:, 1] + 1)), head, training


KEY = 48
SHIFT = np.uint64(64 - KEY)


def _table(counts):
    """key -> (n, n_dev) of all blocks."""
    out, blocks = {}, {}
    for r in counts.collect():
        blocks.setdefault(r["block"], []).append(r.asDict())
    for rows in blocks.values():
        keys, n, d = maxent_lm.sum_counts(rows)
        assert (np.diff(keys.astype(np.int64)) > 0).all()
        assert not set(out) & set(keys.tolist())
        out |= dict(zip(keys.tolist(), zip(n.tolist(), d.tolist())))
    return out


def _tokens(rows, model):
    """Tokens of training texts, their classes, and the texts' left-out flags."""
    import pyarrow as pa
    t = maxent_lm.Tokens(maxent_lm.texts_of(pa.array([r["text"] for r in rows], pa.large_string())))
    return t, model.classes(t), np.array([r["dev"] for r in rows])[t.row]


def test_packed_keys_round_trip():
    for keys in (np.array([0, 1, 5, 2**48 - 1], np.uint64), np.array([7], np.uint64), np.empty(0, np.uint64)):
        assert (maxent_lm.unpack_keys(maxent_lm.pack_keys(keys), len(keys)) == keys).all()
    keys = np.array([0, 3, 2**47, 2**47 + 1, 2**48 - 1], np.uint64)
    assert list(maxent_lm._blocks(keys, 1, 48)) == [(0, 0, 2), (1, 2, 5)] and list(maxent_lm._blocks(keys, 0, 48)) == [(0, 0, 5)]
    assert [maxent_lm.key_size(n) for n in (0, 10**6, 5 * 10**9, 10**19)] == [40, 40, 42, 62]


def test_head_finds_exactly_its_words():
    rng = np.random.default_rng(8)
    h = np.unique(np.concatenate([rng.integers(0, 2**63, 500).astype(np.uint64), np.arange(2**44, 2**44 + 40).astype(np.uint64),
                                  np.array([0, 2**64 - 1], np.uint64)]))
    head = maxent_lm.Head(h, np.arange(len(h)))
    there, n = head.find(np.concatenate([h, h + np.uint64(1), h - np.uint64(1)]))
    known = set(h.tolist())
    probes = np.concatenate([h, h + np.uint64(1), h - np.uint64(1)]).tolist()
    place = {x: i for i, x in enumerate(h.tolist())}
    assert there.tolist() == [x in known for x in probes]
    assert n[there].tolist() == [place[x] for x in probes if x in known] and not n[~there].any()
    assert not maxent_lm.Head(np.empty(0, np.uint64), np.empty(0, np.int64)).find(h)[0].any()


@pytest.mark.parametrize("bits", [0, 5])
def test_feature_counts_are_whole(spark, bits):
    docs = _followers(spark, 60)
    vocab, model, room, head, training = _pieces(docs)
    got = _table(maxent_lm.feature_counts(training.repartition(3), model, head, bits, KEY))
    t, of, dev = _tokens(training.collect(), model)
    want = Counter(), Counter()
    outside = ~head.find(t.hash)[0]
    for keys, flags in [*((k, dev) for k in maxent_lm._follow(t, of)), (maxent_lm._rare(t.hash[outside]), dev[outside])]:
        for k, f in zip((keys >> SHIFT).tolist(), flags.tolist()):
            want[0][k] += 1
            want[1][k] += f
    assert got == {k: (n, want[1][k]) for k, n in want[0].items()}


def test_word_factor_follows_history(spark):
    """Words that the last word tells are likelier by their own pair counts than
    by their class alone, and each context's probabilities sum to one."""
    docs = _followers(spark, 150)
    out = maxent_lm.score(docs).join(docs.select("doc_id", "train"), "doc_id").filter("not train")
    held = out.agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert held > -0.7  # two followers: log10(1/2) = -0.3; with the class factor alone about -1.4
    vocab, model, room, head, training = _pieces(docs)
    counted = _table(maxent_lm.feature_counts(training, model, head, 2, KEY))
    t, of, _ = _tokens(training.collect(), model)
    context, _ = maxent_lm._follow(t, of)
    assert sum(counted[c][0] for c in set((context >> SHIFT).tolist())) == docs.filter("train").count() * 62
    v = vocab.toPandas()
    of_word = np.where(v.prefix < 0, len(room) - 1, np.searchsorted(model.edges, v.prefix, "right"))
    p0 = dict(zip(v.hash.to_numpy().view(np.uint64).tolist(), (v.n_train + 0.5) / 10 ** room[of_word]))
    for last, c in list(set(zip(t.line[t.place - 1].tolist(), of.tolist())))[:40]:
        inside = v.hash.to_numpy()[(of_word == c) & (v.n_train > 0)].view(np.uint64)
        probe = maxent_lm.Tokens.__new__(maxent_lm.Tokens)
        probe.line = np.stack([np.full(len(inside), last, np.uint64), inside], axis=1).ravel()
        probe.place, probe.hash = np.arange(1, 2 * len(inside), 2), inside
        contexts, pairs = maxent_lm._follow(probe, np.full(len(inside), c))
        contexts, pairs = contexts >> SHIFT, pairs >> SHIFT
        whole = counted[int(contexts[0])][0]
        total = 10 ** (np.log10(0.5) - room[c] + maxent_lm.follow_log10(0, whole, 1.0, 2.0))  # the place of unseen words
        total += sum(p0[w] * 10 ** maxent_lm.follow_log10(counted.get(k, (0,))[0], whole, p0[w], 2.0)
                     for w, k in zip(inside.tolist(), pairs.tolist()))
        assert total == pytest.approx(1, abs=1e-6)


def test_scores_by_definition(spark):
    """Word factors from plain counts of words, and class factors of the model."""
    docs = _followers(spark, 120)
    rows = docs.withColumn("dev", F.crc32(F.col("text").cast("binary")) % 8 == 0).orderBy("doc_id").collect()
    vocab, model, room, _, _ = _pieces(docs, rounds=maxent_lm.ROUNDS)
    kinds = {r["hash"]: r["n_train"] for r in vocab.collect()}
    t, of, _ = _tokens(rows, model)
    lines = [["^", *lower(r["text"]).split(), "$"] for r in rows]
    flat = [(i, a, b) for i, line in enumerate(lines) for a, b in zip(line, line[1:])]
    assert len(flat) == len(of)
    pair, context, left_pair, left_context = Counter(), Counter(), Counter(), Counter()
    for (i, a, b), c in zip(flat, of.tolist()):
        if rows[i]["train"]:
            pair[a, b] += 1
            context[a, c] += 1
            if rows[i]["dev"]:
                left_pair[a, b] += 1
                left_context[a, c] += 1
    p0 = [(kinds[h] + 0.5) / 10 ** room[c] for h, c in zip(maxent_lm.signed(t.hash.copy()).tolist(), of.tolist())]
    def gain(prior, left):
        return sum(np.log10(((pair[a, b] - left_pair[a, b]) + prior * p) / ((context[a, c] - left_context[a, c]) + prior) / p)
                   for (i, a, b), c, p in zip(flat, of.tolist(), p0) if rows[i]["train"] and rows[i]["dev"])
    prior = max(maxent_lm.PRIORS, key=lambda x: gain(x, True))
    log_class = model.log_p(t.features(0, len(of)))[np.arange(len(of)), of] / np.log(10)
    want = np.zeros(len(rows))
    for (i, a, b), c, p, lc in zip(flat, of.tolist(), p0, log_class):
        want[i] += lc + np.log10((pair[a, b] + prior * p) / (context[a, c] + prior))
    for settings in ({}, {"block_keys": 1 << 8, "part_bytes": 1 << 10}):
        got = {r["doc_id"]: r["score"] for r in maxent_lm.score(docs, classes=4, **settings).collect()}
        assert [got[r["doc_id"]] for r in rows] == pytest.approx(want, abs=0.02)


def test_unrelated_words_keep_their_class_frequency(spark):
    docs = _followers(spark, 150, related=False)
    ends = [maxent_lm.score(docs, classes=4, priors=p).orderBy("doc_id").collect() for p in ([0.25, 1.0], [])]
    assert [r["score"] for r in ends[0]] == pytest.approx([r["score"] for r in ends[1]], abs=1e-3)


def test_scores_without_training_or_rows(spark):
    docs = awkward(spark).withColumn("train", F.lit(False))
    out = maxent_lm.score(docs).collect()
    assert len(out) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in out)
    assert maxent_lm.score(empty(spark).withColumn("train", F.lit(True))).count() == 0


def test_class_odds_are_the_models():
    """Products of factors give what the sums of weights give, also where single precision ends."""
    rng = np.random.default_rng(3)
    for spread in (1, 60):
        model = maxent_lm.ClassModel(np.array([5, 9]), (spread * rng.normal(
            size=(maxent_lm.FEATURES, maxent_lm.BUCKETS, 4))).astype(np.float32), np.log([0.1, 0.2, 0.3, 0.4]).astype(np.float32))
        f, c = rng.integers(0, maxent_lm.BUCKETS, (maxent_lm.FEATURES, 5000)), rng.integers(0, 4, 5000)
        odds, log_p = maxent_lm.Odds(model), model.log_p(f)
        assert odds.log_of(f, c) == pytest.approx(log_p[np.arange(5000), c], rel=1e-5, abs=1e-5)
        assert odds.p(f) == pytest.approx(np.exp(log_p).T, abs=1e-5)


def test_a_part_asks_with_its_own_counts(spark):
    """What parts ask for holds their training counts, so that these add up to all counts
    and no further table of counts is shuffled; words outside the head keep whole hashes."""
    import pyarrow as pa
    docs = _followers(spark, 60)
    _, model, _, head, _ = _pieces(docs)
    rows = [r.asDict() for r in docs.collect()]
    for r in rows:
        r["state"] = 0 if not r["train"] else 2 if r["doc_id"] % 8 == 1 else 1
    got = {}
    for lo in range(0, 60, 25):
        t = pa.table({"key": [r["doc_id"] for r in rows[lo: lo + 25]], "text": [r["text"] for r in rows[lo: lo + 25]],
                      "state": pa.array([r["state"] for r in rows[lo: lo + 25]], pa.int8())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        part = maxent_lm.Part(sink.getvalue().to_pybytes(), model, head, KEY, False)
        for block, size, keys, n, d in part.asked(3, KEY, 2):
            got.setdefault(block, []).append({"size": size, "keys": keys, "n": n, "n_dev": d})
    counted = {False: {}, True: {}}
    for block, asked in got.items():
        counted[block >= 8] |= {k: (n, d) for k, n, d in zip(*(a.tolist() for a in maxent_lm.sum_counts(asked)))}
    t = maxent_lm.Tokens(maxent_lm.texts_of(pa.array([r["text"] for r in rows], pa.large_string())))
    state, outside = np.array([r["state"] for r in rows])[t.row], ~head.find(t.hash)[0]
    for words, lists in ((False, [(k >> SHIFT, state) for k in maxent_lm._follow(t, model.classes(t))]),
                         (True, [(t.hash[outside] >> np.uint64(2), state[outside])])):
        want = {}
        for k, s in ((k, s) for keys, states in lists for k, s in zip(keys.tolist(), states.tolist())):
            n, d = want.get(k, (0, 0))
            want[k] = n + (s > 0), d + (s == 2)
        assert counted[words] == want


def test_scores_need_no_join_after_the_parts(spark):
    """Words outside the head are scored in their part: no list of them is written and joined."""
    plan = maxent_lm.score(_followers(spark, 20), head=3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan
