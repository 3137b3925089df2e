import math

from pyspark.sql import functions as F

from agora.functions import maps as MP
from agora.functions import text as T
from agora.functions import vectors as V


def test_tokenize_stop_ngrams(spark):
    df = spark.createDataFrame([("The Café is NOT open, the_end a b 42",)], "t string")
    r = df.select(T.remove_stop_words(T.tokenize("t")).alias("k")).first().k
    assert r == ["café", "open", "the_end", "42"]
    g = df.select(T.ngrams(F.array(*[F.lit(x) for x in "a b c".split()]), 1, 2).alias("g")).first().g
    assert g == ["a", "b", "c", "a b", "b c"]
    e = df.select(T.ngrams(F.array(F.lit("x")), 2, 2).alias("g")).first().g
    assert e == []


def test_excerpt_and_chunks(spark):
    words = " ".join(f"w{i:03d}" for i in range(300))
    df = spark.createDataFrame([(words,), ("",)], "t string")
    rows = df.select(T.excerpt("t").alias("x"), T.word_chunks("t", 128).alias("c")).collect()
    lines = rows[0].x.split("<br>")
    assert all(len(line) <= 100 for line in lines)
    assert " ".join(lines) == words[:900].strip()
    assert [len(c.split()) for c in rows[0].c] == [128, 128, 44]
    assert rows[1].x == "" and rows[1].c == []


def test_vectors_edge_cases(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], None)], "a array<double>, b array<double>")
    r = df.select(V.cosine("a", "b").alias("c"), V.l2_normalize("a").alias("n"),
                  V.l2_normalize("b").alias("nb")).collect()
    assert r[0].c == 0.0 and r[1].c == 0.0
    assert r[0].n == [0.6, 0.8] and r[0].nb == [0.0, 0.0]


def test_quantize_roundtrip_bound(spark):
    vals = [[-1.5, -1.0, -0.333, 0.0, 0.25, 0.999, 2.0]]
    df = spark.createDataFrame([(v,) for v in vals], "e array<double>")
    r = df.select(V.quantize("e").alias("q")).select("q", V.dequantize("q").alias("d")).first()
    assert r.q[0] == 0 and r.q[-1] == 65535
    for x, y in zip(vals[0], r.d):
        assert abs(max(-1, min(1, x)) - y) <= 1 / 65535 + 1e-12


def test_metadata_get_set(spark):
    df = spark.createDataFrame([('{"a": "1"}',), (None,)], "p string")
    r = df.select(MP.metadata_get(MP.json_to_map("p"), "a").alias("g"),
                  MP.metadata_set(MP.json_to_map("p"), "c", F.lit(5)).alias("s")).collect()
    assert r[0].g == "1" and r[1].g == "Unknown"
    assert r[0].s == {"a": "1", "c": "5"} and r[1].s == {"c": "5"}
    assert math.isclose(1.0, 1.0)


def test_embedding_holds_some_documents_at_a_time():
    import numpy as np
    import pyarrow as pa

    from agora.operators import embed
    tokens = [[f"w{i}", f"w{i % 7}", "x"] if i % 5 else None for i in range(3 * embed._ROWS + 1)]
    batch = pa.record_batch({"doc_id": list(range(len(tokens))), "tokens": pa.array(tokens, pa.list_(pa.string()))})
    out = list(embed._hashed("doc_id", 16)([batch]))
    assert [b.num_rows for b in out] == [embed._ROWS] * 3 + [1]
    alone = [next(iter(embed._hashed("doc_id", 16)([batch.slice(i, 1)]))) for i in range(0, len(tokens), 97)]
    whole = pa.Table.from_batches(out).to_pylist()
    for one in alone:
        r = one.to_pylist()[0]
        assert whole[r["doc_id"]]["doc_id"] == r["doc_id"] and np.allclose(whole[r["doc_id"]]["embedding"], r["embedding"])
