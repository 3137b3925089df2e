"""Capture index, collocations and hard negatives against plain versions."""
import gzip
import hashlib
import random
import re
from collections import Counter

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from agora.llm import capture_index, hard_negatives, phrases
from agora.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import awkward, empty


# ---------------------------------------------------------------- capture index

PAGES = "page_id long, url string, html string, key string, type string, file string"


def _pages(spark):
    big = "<p>long page</p>" * 40
    rows = [
        (1, "http://www.b.example.com/x", big), (2, "http://a.example.org/", big), (3, "https://b.example.com:443/x#top", "short"),
        (4, None, "short"), (5, "http://a.example.org/?q=1 2", None), (6, "not a url\r\nat all", ""),
        (7, "http://[bad", big + "\r\n\r\nWARC/1.1\r\n"), (8, "http://user@h.example:8080/ü/日本", big + "ü日本"),
        (None, "http://n.example/", big), (9, "http://z.example/", "x" * 99), (10, "http://z.example/", "x" * 99),
        (11, "http://z.example/", "y" * 100), (12, "http://z.example/", "y" * 100), (12, "http://z.example/", "y" * 100),
        (13, "http://long.example/", "word " * 400_000), (2, "http://a.example.org/", big),
    ]
    return spark.createDataFrame([(*r, "k", "t", "f") for r in rows], PAGES)


def _plain(rows):
    first = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) >= 100 and r["page_id"] is not None:
            first[body] = min(first.get(body, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        of = first.get(body)
        again = of is not None and r["page_id"] != of
        out.append((r["page_id"], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=repr)


def _read(archive, keys):
    rows = capture_index.fetch(archive, capture_index.lookup(archive, keys)).collect()
    assert all(r["sound"] for r in rows)
    for r in rows:
        if r["type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["digest"]
    return sorted(((r["page_id"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in rows), key=repr)


@pytest.mark.parametrize("settings", [{}, {"lines": 2, "shard": 3, "file_bytes": 300}])
def test_archive_round_trip(spark, settings):
    pages = _pages(spark)
    archive = capture_index.write_archive(pages, **settings)
    assert _read(archive, capture_index.url_keys(pages)) == _plain(pages.collect())


def test_lookup_finds_all_captures_of_a_key_and_no_others(spark):
    rows = [(i, f"http://h{i % 7}.example/{i % 50}", f"page {i}" * 20) for i in range(3000)] + \
           [(5000 + i, "http://hot.example/", "same " * 40) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = capture_index.write_archive(pages, lines=16, shard=400)
    assert len(archive.shards) > 5  # the hot key lies in several shards
    wanted = ["http://hot.example/", "http://h3.example/3", "http://nowhere.example/", "http://h3.example", "http://zzz.example/"]
    keys = capture_index.url_keys(spark.createDataFrame([(u,) for u in wanted], "url string"))
    found = sorted(r["page_id"] for r in capture_index.lookup(archive, keys).collect())
    assert found == sorted(i for i, u, _ in rows if u in wanted)


def test_archive_files_are_plain_gzip_warc(spark):
    archive = capture_index.write_archive(_pages(spark).filter("page_id < 5"))
    store, top = pafs.FileSystem.from_uri(f"{archive.folder}/warc")
    records = []
    for info in store.get_file_info(pafs.FileSelector(top)):
        data = gzip.decompress(store.open_input_file(info.path).read())
        while data:
            fields, block, _, _ = capture_index.parse_record(data)
            records.append(fields["WARC-Type"])
            end = data.index(b"\r\n\r\n") + 4 + len(block)
            assert data[end: end + 4] == b"\r\n\r\n"
            data = data[end + 4:]
    assert Counter(records)["response"] + Counter(records)["revisit"] == 5
    assert Counter(records)["revisit"] == 2  # pages 2, twice, repeat page 1


def test_url_keys():
    key = capture_index.url_key
    assert key("https://www.Example.com:443/a?b=1#frag") == "com,example)/a?b=1"
    assert key("http://Example.com") == "com,example)/"
    assert key("http://example.com:8080?x") == "com,example:8080)/?x"
    assert key(None) == "-" and key("") == ")/"
    assert "\n" not in key("a\nb") and " " not in key("http://x.example/a b")


def test_archive_of_an_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    archive = capture_index.write_archive(pages)
    assert archive.shards == []
    assert capture_index.fetch(archive, capture_index.lookup(archive, capture_index.url_keys(pages))).count() == 0


# ----------------------------------------------------------------- collocations

def _collocations(rows, least, top, cover=50):
    """Every phrase counted, then scored and dropped by definition."""
    out = []
    langs = {(r["lang"] if r["lang"] is not None else "und") for r in rows}
    for lang in langs:
        f = Counter()
        for r in rows:
            if (r["lang"] if r["lang"] is not None else "und") != lang:
                continue
            text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                w = re.findall(r"[^\x20\x09]+", piece)
                for k in (1, 2, 3):
                    f.update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept, longer = [], Counter()
        for q, b in candidates.items():
            for p in (q[:2], q[1:]) if len(q) == 3 else ():
                longer[p] = max(longer[p], b)
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= cover * a:
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((s, a, " ".join(p), f[p[:k]], f[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(kept[:top], 1)]  # noqa: E741
    return sorted(out)


def _made(spark, rows=300, seed=3):
    """Phrases of known strength among random words, several languages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    fixed = ["alpha beta", "alpha beta gamma", "New York city", "of the", "the end of", "x y x y", "tab\tword", "a b"]
    out = []
    for i in range(rows):
        text = "".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice([" ", " ", " ", ", ", "\n", "!"])
                       for _ in range(30))
        out.append((i, text, rng.choice(["en", "en", "de", None, "und"]), 1))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, a long")


@pytest.mark.parametrize("top", [1, 7, 40, 2000])
def test_collocations_are_the_definition(spark, top):
    docs = _made(spark)
    found = phrases.collocations(docs, least=4, top=top)
    assert sorted(map(tuple, found.collect())) == _collocations(docs.collect(), 4, top)


def test_collocations_without_frequent_word_table(spark, monkeypatch):
    """All words travel as hashes, in windows of a few tokens."""
    monkeypatch.setattr(phrases, "HEAD", 3)
    monkeypatch.setattr(phrases, "WINDOW", 50)
    docs = _made(spark, 150, 5)
    assert sorted(map(tuple, phrases.collocations(docs, least=3, top=30).collect())) == _collocations(docs.collect(), 3, 30)


def test_collocations_of_awkward_rows(spark):
    docs = awkward(spark)
    found = phrases.collocations(docs, least=1, top=50)
    assert sorted(map(tuple, found.collect())) == _collocations(docs.collect(), 1, 50)


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(empty(spark)).count() == 0
    assert phrases.collocations(awkward(spark, only=(5, 6, 7))).count() == 0


def test_collocation_arithmetic_passes_64_bits(spark):
    row = spark.createDataFrame([(999_999_999_999_999, 10**15 - 1, 10**15 - 2)], "a long, l long, r long")
    a, l, r = row.first()  # noqa: E741
    assert row.select(phrases._score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (l * r)


# --------------------------------------------------------------- hard negatives

def _negatives(rows, positives=5, negatives=5, low=80):
    rows = {(r["id"], r["label"], tuple(r["vector"])): r["anchor"] for r in rows
            if r["id"] is not None and r["label"] is not None and r["vector"] is not None and None not in r["vector"]}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, is_anchor in rows.items():
        if not is_anchor:
            continue
        others = [(dot(a[2], b[2]), b) for b in rows if b != a and len(b[2]) == len(a[2])]
        same = sorted((-s, b[0]) for s, b in others if b[1] == a[1])[:positives]
        for p, pid in same:
            p = -p
            inside = sorted((-s, b[0]) for s, b in others if b[1] != a[1] and low * p <= 100 * s <= 100 * p)
            out += [(a[0], pid, i, nid, p, -s) for i, (s, nid) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def _vectors(spark, n=600, labels=4, seed=1, hot=0):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(labels), [rng.randint(-3, 6) for _ in range(6)], i % 20 == 0) for i in range(n)]
    rows += [(n + i, 1, [2, 2, 2, 2, 2, 2], i % 50 == 0) for i in range(hot)]
    return spark.createDataFrame(rows, "id long, label long, vector array<long>, anchor boolean")


@pytest.mark.parametrize("hot", [0, 300])
def test_hard_negatives_are_the_definition(spark, monkeypatch, hot):
    """Many ties; with ``hot``, one vector holds a third of the rows."""
    rows = _vectors(spark, hot=hot)
    expected = _negatives(rows.collect())
    assert sorted(map(tuple, hard_negatives.mine(rows).collect())) == expected
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "_AT_ONCE", 100)
    assert sorted(map(tuple, hard_negatives.mine(rows).collect())) == expected


def test_hard_negatives_of_awkward_rows(spark):
    rows = spark.createDataFrame([
        (1, "a", [3, 4], True, "x"), (1, "a", [3, 4], True, "y"), (2, "a", [3, 3], None, "x"), (3, "b", [3, 3], True, "x"),
        (4, "b", [3, 2], False, "x"), (4, "a", [4, 2], True, "x"), (5, None, [1, 1], True, "x"), (6, "b", None, True, "x"),
        (7, "b", [1, None], True, "x"), (None, "b", [3, 4], True, "x"), (8, "b", [1, 2, 3], True, "x"), (9, "c", [-3, -4], True, "x"),
        (10, "c", [-3, -4], False, "x"), (11, "b", [], True, "x"), (12, "b", [2**29, 1], True, "x"), (13, "b", [2**29, 0], False, "x"),
    ], "id long, label string, vector array<long>, anchor boolean, score string")
    assert sorted(map(tuple, hard_negatives.mine(rows).collect())) == _negatives(rows.collect())
    assert hard_negatives.mine(rows.limit(0)).count() == 0
    assert hard_negatives.mine(rows.withColumn("anchor", F.lit(False))).count() == 0


def test_pairs_sent_on_are_bounded(spark, monkeypatch):
    """A block sends on at most positives * (negatives + 1) rows of an anchor."""
    rows = _vectors(spark, n=400, hot=800)
    seen = {}
    plain = hard_negatives._met

    def met(anchors, others, pick, blocks):
        out = plain(anchors, others, pick, blocks)
        most = out.groupBy("anchor_id", "anchor_key").count().agg(F.max("count")).first()[0]
        seen[len(seen)] = most
        return out

    monkeypatch.setattr(hard_negatives, "_met", met)
    hard_negatives.mine(rows).count()
    assert seen[0] <= 5 and seen[1] <= 25


def test_embeddings_hard_negatives(spark):
    from agora.llm.queries import op13
    found = op13(spark, SF["0.001"])
    assert found.count() > 0 and found.filter("100 * negative_score > 100 * positive_score").count() == 0
    assert table(spark, SF["0.001"], "embeddings").count() > 0
