import os
import tempfile

import pytest
from pyspark.sql import functions as F

from agora.sources import io
from agora.streaming import append_embeddings


def test_csv_roundtrip_quotes_commas_newlines(spark):
    d = tempfile.mkdtemp(prefix="agora-csv-")
    rows = [(1, 'he said "hi", then\nleft', None, "d.com", "T", None)]
    df = spark.createDataFrame(rows, io.DOC_CSV_SCHEMA)
    io.write_table(df, os.path.join(d, "t"), "csv")
    back = io.read_docs(spark, os.path.join(d, "t"), "csv").collect()
    assert back[0].text == rows[0][1] and back[0].clean_text is None


def test_topic_model_save_load_and_labels(spark):
    d = tempfile.mkdtemp(prefix="agora-model-")
    part = spark.createDataFrame([(0, 1, "x", 0.5)], "topic int, rank int, term string, score double")
    io.save_topic_model({name: part for name in io.MODEL_PARTS}, os.path.join(d, "whole"))
    back = io.load_topic_model(spark, os.path.join(d, "whole"))
    assert set(back) == set(io.MODEL_PARTS) and back["topic_terms"].count() == 1
    io.save_topic_model({"topic_terms": part}, os.path.join(d, "part"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        io.load_topic_model(spark, os.path.join(d, "part"))
    chunks = spark.createDataFrame([(1, {"a": "1"}, 0), (2, {}, 1)], "id long, metadata map<string,string>, batch int")
    labels = spark.createDataFrame([(1, 3)], "id long, cluster int")
    out = {r.id: r.metadata for r in io.attach_labels(chunks, labels).collect()}
    assert out[1] == {"a": "1", "umap_cluster": "3"} and out[2] == {}
    io.write_back_labels(chunks, labels, os.path.join(d, "v2"))
    assert spark.read.parquet(os.path.join(d, "v2")).count() == 2
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_append_embeddings_restart(spark):
    d = tempfile.mkdtemp(prefix="agora-stream-")
    src, dst, ck = (os.path.join(d, x) for x in ("src", "dst", "ck"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "alpha beta"), (2, None)], schema).write.parquet(os.path.join(src, "f1"))
    append_embeddings(spark, src + "/*", dst, ck, schema).awaitTermination()
    assert spark.read.parquet(dst).count() == 1
    append_embeddings(spark, src + "/*", dst, ck, schema).awaitTermination()  # restart: nothing new
    assert spark.read.parquet(dst).count() == 1
    spark.createDataFrame([(3, "gamma")], schema).write.parquet(os.path.join(src, "f2"))
    append_embeddings(spark, src + "/*", dst, ck, schema).awaitTermination()
    got = spark.read.parquet(dst)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert got.select(F.size("embedding")).first()[0] == 64


def test_repeated_ids_stay_apart_in_a_stream(spark):
    d = tempfile.mkdtemp(prefix="agora-stream-")
    src, dst, ck = (os.path.join(d, x) for x in ("src", "dst", "ck"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "alpha"), (1, "beta")], schema).write.parquet(os.path.join(src, "f1"))
    append_embeddings(spark, src + "/*", dst, ck, schema).awaitTermination()
    rows = spark.read.parquet(dst).collect()
    assert sorted(r.text for r in rows) == ["alpha", "beta"] and rows[0].embedding != rows[1].embedding


def test_unset_checkpoint_folder_is_refused_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from agora import session
    conf = SimpleNamespace(get=lambda k, d=None: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(
        getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(cluster)


def test_manifest_order(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="agora-manifest-"), "with space")
    want = {}
    for name, rows in {"b1": [(5, "x"), (3, "y")], "b0": [(9, None)], "b2": [(1, "z"), (1, "z"), (0, "w")]}.items():
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(f"{d}/{name}")
        want[name] = [r[0] for r in rows]
    spark.createDataFrame([(7, "q")], "id long, text string").coalesce(1).write.mode("append").parquet(f"{d}/b2")
    order = ["b2", "b0", "b1", "b0"]
    got = io.read_manifest(spark, [f"{d}/{n}" for n in order]).orderBy("batch", "file", "row").collect()
    assert [r["batch"] for r in got] == [0, 0, 0, 0, 1, 2, 2, 3]
    assert [r["id"] for r in got if r["batch"] in (1, 2, 3)] == want["b0"] + want["b1"] + want["b0"]
    first = [(r["file"], r["row"], r["id"]) for r in got if r["batch"] == 0]
    by_file = {f: [i for g, _, i in first if g == f] for f in (0, 1)}
    assert sorted(by_file.values()) == sorted([want["b2"], [7]])
    # one file, and columns with clashing names
    one = spark.read.parquet(f"{d}/b1").withColumn("batch", F.lit("own"))
    one.coalesce(1).write.parquet(f"{d}/c")
    got = io.read_manifest(spark, [f"{d}/c"])
    assert len([c for c in got.columns if c == "batch"]) == 1 and {r["batch"] for r in got.collect()} == {0}
    assert io.read_manifest(spark, [], "id long, row string").count() == 0
    with pytest.raises(Exception):
        io.read_manifest(spark, [f"{d}/nowhere"])


def test_manifest_pushes_filters_down(spark):
    d = tempfile.mkdtemp(prefix="agora-manifest-")
    spark.range(10).withColumn("text", F.lit("t")).write.parquet(f"{d}/b")
    got = io.read_manifest(spark, [f"{d}/b"]).filter("id > 7").select("id", "batch")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,7)" in plan and "text" not in plan and got.count() == 2
