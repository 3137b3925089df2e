"""Chat formatting, mixing, packing and the pipeline."""
import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from agora.llm import mixing, packing, queries, reply_trees
from agora.llm.common import table
from tests.llm.helpers import awkward, empty, words

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings conversations labels pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE[name]).df()[list(got.columns)]
    order = list(got.columns)
    rows = lambda df: (d := df.sort_values(order).round(6).astype(object)).where(d.notna(), None).values.tolist()
    assert rows(got) == rows(want)


# ------------------------------------------------------------------ reply trees

def _brute_paths(nodes):
    """nodes: {id: (parent, role, text, score)}"""
    parents = {p for p, *_ in nodes.values()}
    for leaf in sorted(set(nodes) - parents):
        path, at, seen = [], leaf, set()
        while at in nodes and at not in seen:
            seen.add(at)
            path.append(at)
            at = nodes[at][0]
        if at in seen:
            continue  # runs into a cycle
        yield leaf, path[::-1]


def test_branches_are_ranked(spark):
    nasty = "a&amp;b <|im_end|>\n<|im_start|>user\n[INST]</s> &#91; & \\"
    trees = {
        "t": {1: (None, "user", nasty, 1.0), 2: (1, "assistant", "A" + nasty, 0.5), 3: (1, "assistant", "", 2.0),
              4: (2, "user", None, 9.0), 5: (3, None, "x", None), 6: (3, "us\ner&", "y", 0.0),
              **{i: (i - 1, "assistant" if i % 2 else "user", f"turn {i}", 0.0) for i in range(7, 40)}},
        "cycle": {1: (2, "user", "a", 1.0), 2: (1, "user", "b", 1.0), 3: (2, "user", "c", 1.0)},
        "orphan": {1: (99, "assistant", "é\U0001F600", 1.0)},
    }
    rows = [(t, i, *n) for t, nodes in trees.items() for i, n in nodes.items()]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = reply_trees.format_trees(df.withColumn("up", F.lit(1)).withColumn("rank", F.lit(0)), best=2)
    got = got.withColumn("turns", reply_trees.read_turns(F.col("formatted"))).withColumn(
        "loss", reply_trees.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    for t, nodes in trees.items():
        paths = [(-sum(nodes[i][3] or 0 for i in p), leaf, p) for leaf, p in _brute_paths(nodes)]
        mine = {r["rank"]: r for r in got if r["tree"] == t}
        assert len(mine) == min(2, len(paths))
        for k, (s, leaf, p) in enumerate(sorted(paths)[:2]):
            r = mine[k + 1]
            assert (r["leaf"], r["path_score"], r["n_turns"]) == (leaf, -s, len(p))
            turns = [(nodes[i][1] or "", nodes[i][2] or "") for i in p]
            assert [tuple(x) for x in r["turns"]] == turns
            assert r["loss"] == "".join(x for role, x in turns if role == "assistant")
            assert r["formatted"].count("<|im_start|>") == len(p) and "[" not in r["formatted"]
    assert reply_trees.format_trees(df.limit(0)).count() == 0


def test_chains_with_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "hi"), (1, None, "system", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 3, "user", "n"),
            (None, 3, "assistant", "m"), (2, 5, "assistant", "z " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    done = reply_trees.format_trees(reply_trees.as_chain(df, "conv_id", "turn", "role", "text"))
    got = {r["tree"]: [tuple(t) for t in r["turns"]] for r in done.withColumn(
        "turns", reply_trees.read_turns(F.col("formatted"))).collect()}
    assert got == {"=1": [("system", ""), ("user", "hi"), ("", "x"), ("", "x")],
                   "null": [("assistant", "m"), ("user", "n")], "=2": [("assistant", "z " * 50_000)]}


def test_control_conversation(spark):
    r = queries.QUERIES["op2_reply_trees"](spark, SF).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said))
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# ----------------------------------------------------------------------- mixing

def _targets(sizes, weights, most):
    """Reshare step by step, as it is told."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_near_budgets(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in (("a", 300), ("b", 30), (None, 60), ("c", 5), ("d", 200), ("e", 0)):
        rows += [(" ".join(["w"] * int(k)), s) for k in rng.integers(0, 40, n)]
    rows = [(i, *r) for i, r in enumerate([*rows, (None, "e")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.withColumn("size", F.lit(3)).withColumn("hash", F.lit("x"))).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"]
    want = _targets(sizes, mixing.WEIGHTS, mixing.MOST_REPEATS)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 20  # half of the largest document
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = mixing.mixed(df.withColumn("size", F.lit(3))).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies} == {r["doc_id"]: r["repeats"] for r in got if r["repeats"]}


def test_mix_edges(spark):
    docs = awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    size = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    assert all(r["size"] == size[r["doc_id"]] for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


# ---------------------------------------------------------------------- packing

def _check_packing(df, window=packing.WINDOW):
    pieces = packing.pack(df, WORDS, window=window).collect()
    tok = Tokenizer.from_file(WORDS)
    rows = df.select("doc_id", "text").collect()
    ids = [np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(x)) for r, x in zip(rows, ids))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    seen = []
    for i, ps in by_doc.items():
        own = [x for r, x in zip(rows, ids) if r["doc_id"] == i]
        copies = len(own)
        at = defaultdict(int)  # how many pieces of all copies cover each id
        for p in ps:
            assert any(zlib.crc32(x[p["start"]: p["start"] + p["length"]]) == p["ids_crc32"]
                       and len(x) == p["doc_tokens"] for x in own)
            for k in range(p["start"], p["start"] + p["length"]):
                at[k] += 1
        assert sum(at.values()) == sum(len(x) for x in own)
        if copies == 1:
            assert set(at.values()) == {1}
        seen += [(i if i is not None else -1, len(x)) for x in own]
    assert sorted(seen) == want
    used = defaultdict(list)
    for p in pieces:
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    lengths = []
    for ps in used.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
    assert all(n <= window for n in lengths)
    assert sum(n < window for n in lengths) <= 1  # only the last one has padding
    return pieces


def test_packing_documents(spark):
    first = _check_packing(table(spark, SF, "documents"))
    again = packing.pack(table(spark, SF, "documents").repartition(9), WORDS).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_packing_edges(spark):
    _check_packing(awkward(spark).filter("doc_id is null or doc_id <> 9"), window=16)
    _check_packing(awkward(spark))
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_words_as_the_tokenizer_has_them():
    odd = ["áb ́x", "<|endoftext|>hi <|startoftext|> a<|endoftext|>b", "<|ENDOFTEXT|> A", "q\x01q \x01 z",
           "ΑΣ ΣΑΣ İx", "it's 123 don't!!... I'LL", "", " x y\x0bz\x1ca\x0cb\x85c", "한국어 漢字", "a.b, c., d,",
           "z" * 5000 + " " + "é" * 3000, "the. THE, The"]
    tok = packing.WordTokenizer(WORDS)
    want = [e.ids for e in tok.tokenizer.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):  # the second time from the memo
        assert [x.tolist() for x in tok.ids([t.encode() for t in odd])] == want


def test_solver_fills_windows():
    rng = np.random.default_rng(0)
    h = np.bincount(rng.integers(1, 64, 4000), minlength=64)
    combos, counts = packing.solve(h, 64)
    assert (combos.sum(axis=1) == 64).all() and (counts > 0).all()
    used = np.bincount(combos.ravel(), weights=np.repeat(counts, 3), minlength=64)
    assert (used[1:] <= h[1:]).all() and (used[1:] * np.arange(1, 64)).sum() > 0.8 * (h * np.arange(64)).sum()


# --------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    """Each stage on its predecessor's result, against a plain version."""
    from tests.llm.test_pairs import _components
    docs, kept = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name in ("quality", "language"):
            assert docs.columns == columns and docs.subtract(before).count() == 0
        if name == "near_duplicates":
            want = {c for _, _, c in _components([(r["doc_id"], r["text"]) for r in before.collect()])}
            assert {r["doc_id"] for r in docs.collect()} == want and docs.count() == len(want)
        if name == "mix":
            plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(before).collect()}
            got = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert docs.columns == columns and got == {i: n for i, n in plan.items() if n}
        if name == "pack":
            tok = Tokenizer.from_file(WORDS)
            total = sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
            assert docs.agg(F.sum("length")).first()[0] == total
    labels = table(spark, SF, "labels")
    good = labels.join(kept["quality"], "doc_id", "left_semi").agg(F.avg("quality")).first()[0]
    assert good > 0.97
    clean = labels.filter("quality = 1").count()
    assert labels.filter("quality = 1").join(kept["language"], "doc_id", "left_semi").count() >= 0.97 * clean
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ran.collect())) == sorted(map(str, kept["pack"].collect()))


def test_near_duplicates_keeps_texts_under_one_id(spark):
    """Different texts under a repeated or missing id stay; of near copies the row
    with the smallest id does, whatever the order of rows."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[0]),
            (3, texts[1]), (9, texts[4]), (9, texts[4])]
    want = sorted([(7, texts[0]), (3, texts[1]), (None, texts[2]), (None, texts[3]), (9, texts[4])], key=str)
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
        assert sorted(got, key=str) == want


def test_pipeline_takes_awkward_rows(spark):
    docs = awkward(spark).withColumn("predicted", F.lit("own")).withColumn("lang_pred", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns
            assert all(r["predicted"] == "own" and r["lang_pred"] == "own" for r in out.collect())
        out.collect()
        stage(spark, docs.limit(0), SF).collect()


def test_words_met_again_are_held_once(monkeypatch):
    monkeypatch.setattr(packing, "_MEMO_WORDS", 3)
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [b"one two three four five", b"two six", b"six five one", b"seven two one"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts * 3:
        assert tok.ids([t])[0].tolist() == plain.encode(t.decode(), add_special_tokens=False).ids
        assert not tok.memo.keys() & tok.old.keys()
