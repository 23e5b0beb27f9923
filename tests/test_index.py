"""The stored text index: every search equals a scan of what is live, whatever was added, deleted and compacted."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, text_index
from tessera.sources.shared import file_system

KEYS = ["doc_id", "chunk_id"]
SCHEMA = "doc_id long, chunk_id int, file_md5 string, user_id long, content string"


def rows(n=1500, seed=2):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(60_000)]
    out = [(i // 3, i % 3 + 1, f"m{i // 3}", i // 3 % 7, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    return out + [(9000, 1, "m9000", 1, "alpha alpha beta"), (9001, 1, "m9001", 1, "Alpha beta gamma " * 3), (9002, 1, "m9002", 2, None), (9002, 2, "m9002", 2, "")]


def plain(df, query, k, allowed=None):
    hits = retrieval.bm25(df.withColumn("content", F.coalesce("content", F.lit(""))), query, KEYS, allowed)
    return [(r.doc_id, r.chunk_id, round(r.bm25, 8)) for r in retrieval.ranked(hits, "bm25", KEYS, k).orderBy("rank").collect()]


def found(spark, folder, query, k, allowed=None, read=None):
    return [(r.doc_id, r.chunk_id, round(r.bm25, 8)) for r in text_index.search(spark, folder, query, k, allowed, read).orderBy("rank").collect()]


QUERIES = (["w1", "w2", "alpha", "none"], ["w17", "w400", "beta"])


def test_index_follows_adds_deletes_and_compaction(spark, tmp_path):
    folder, all_ = f"file://{tmp_path}/index", spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert text_index.manifest(spark, folder).version == 0 and found(spark, folder, ["w1"], 5) == []
    text_index.add(all_.where("doc_id % 2 = 0"), folder, KEYS)
    text_index.add(all_.where("doc_id % 2 = 1"), folder)
    allowed = F.col("user_id").isin(1, 4)
    assert found(spark, folder, QUERIES[1], 10) == plain(all_, QUERIES[1], 10)
    assert found(spark, folder, QUERIES[0], 25, allowed) == plain(all_, QUERIES[0], 25, allowed)
    assert found(spark, folder, ["nothing"], 5) == found(spark, folder, [], 5) == []
    text_index.delete(spark, folder, all_.where("user_id = 3 or doc_id = 9000").select("file_md5"))
    text_index.delete(spark, folder, spark.createDataFrame([("unknown",)], "file_md5 string"))
    text_index.add(all_.where("doc_id = 3"), folder)
    left = all_.where("(user_id <> 3 and doc_id <> 9000) or doc_id = 3")
    assert found(spark, folder, QUERIES[0], 10) == plain(left, QUERIES[0], 10)
    text_index.delete(spark, folder, all_.where("doc_id = 3").select("file_md5"))
    left = left.where("doc_id <> 3")
    m = text_index.compact(spark, folder)
    assert len(m.segments) == 1 and not m.deletes and m.chunks == left.count() == text_index.live(spark, folder).count()
    assert found(spark, folder, QUERIES[0], 10) == plain(left, QUERIES[0], 10)


def test_search_reads_few_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST_TILES", 2)
    folder, df = f"file://{tmp_path}/index", spark.createDataFrame([*rows(6000), *[(20_000 + i, 1, "x", 1, "w1 rare rare rare") for i in range(12)]], SCHEMA).coalesce(1)
    text_index.add(df, folder, KEYS)
    read = {}
    assert found(spark, folder, ["rare", "w1"], 10, None, read) == plain(df, ["rare", "w1"], 10)
    assert read["scored"] < read["tiles"] / 5
    assert found(spark, folder, ["w1", "w2"], 10, None, read) == plain(df, ["w1", "w2"], 10)


def test_empty_segments_and_rival_writers(spark, tmp_path):
    folder, none = f"file://{tmp_path}/index", spark.createDataFrame([], SCHEMA)
    text_index.add(none, folder, KEYS)
    assert found(spark, folder, ["w1"], 5) == []
    text_index.add(spark.createDataFrame([(1, 1, "a", 1, "...")], SCHEMA), folder)
    assert found(spark, folder, ["w1"], 5) == [] and text_index.manifest(spark, folder).chunks == 1
    with pytest.raises(RuntimeError, match="another writer"):
        text_index._publish(spark, folder, text_index.Manifest(version=2))


def shuffled(spark):
    """Bytes that the session's tasks have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_building_and_compacting_shuffle_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RUN_TERMS", 300)  # several runs in a task, which cut tiles in two
    folder, df = f"file://{tmp_path}/index", spark.createDataFrame(rows(2000), SCHEMA).repartition(3).persist()
    assert df.count() == 2004
    before = shuffled(spark)
    text_index.add(df, folder, KEYS)
    assert shuffled(spark) - before < 2000  # a few counts, not the postings
    for query in QUERIES:
        assert found(spark, folder, query, 10) == plain(df, query, 10)
    before = shuffled(spark)
    text_index.compact(spark, folder)
    assert shuffled(spark) - before < 2000
    assert found(spark, folder, QUERIES[0], 10) == plain(df, QUERIES[0], 10)
    stored = spark.read.parquet(f"{folder}/segments/{text_index.manifest(spark, folder).segments[0]}/postings")
    assert stored.count() and stored.where("size(at) <> df or array_max(tf) <> max_tf or array_min(dl) <> min_dl").count() == 0


def test_one_search_builds_no_index(spark):
    from tessera.plans import search

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no driver tables")
    hits = lambda: [(r.rank, r.doc_id, r.chunk_id, round(r.bm25, 8)) for r in search.lexical(spark, data, 20).orderBy("rank").collect()]
    before = shuffled(spark)
    scanned = hits()
    assert shuffled(spark) - before < 2000 and not text_index.manifest(spark, search.stored_index(spark, data)).version
    before = shuffled(spark)
    assert search.search_attach_filename(spark, data).count() == search.TOP
    assert shuffled(spark) - before < 10_000  # not all files by md5
    folder = search.build_index(spark, data)
    assert text_index.manifest(spark, folder).version == 1 and hits() == scanned
    fs, path = file_system(spark, folder)
    fs.delete(path, True)  # other tests' searches scan


def test_delete_by_many_rows_keeps_statistics(spark, tmp_path):
    folder, df = f"file://{tmp_path}/index", spark.createDataFrame(rows(), SCHEMA)
    text_index.add(df, folder, KEYS)
    text_index.delete(spark, folder, df.where("user_id < 5").select("file_md5", "user_id"))
    left = df.where("user_id >= 5")
    m = text_index.manifest(spark, folder)
    assert m.chunks == left.count() and "terms" not in spark.read.parquet(f"{folder}/deletes/{m.deletes[0]}/dead").columns
    assert found(spark, folder, QUERIES[1], 10) == plain(left, QUERIES[1], 10)


def test_delete_leaves_other_chunks_terms_in_place(spark, tmp_path):
    rng = random.Random(5)
    made = [(i, 1, f"m{i}", i % 50, " ".join(f"x{rng.randrange(10**9)}" for _ in range(60))) for i in range(3000)]
    folder, df = f"file://{tmp_path}/index", spark.createDataFrame(made, SCHEMA)
    text_index.add(df, folder, KEYS)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if what goes were too large for Spark to broadcast
    try:
        before = shuffled(spark)
        m = text_index.delete(spark, folder, df.where("user_id = 3").select("doc_id"))
        assert shuffled(spark) - before < 500_000  # narrow rows and the terms of 60 chunks, not 3000 chunks' terms
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert m.chunks == 2940 and text_index.deleted(spark, folder, m) == 60
    lost = spark.read.parquet(f"{folder}/deletes/{m.deletes[0]}/terms")
    assert -lost.agg(F.sum("df")).first()[0] == sum(len(set(r[4].split())) for r in made if r[3] == 3)


def test_rare_terms_have_one_block_in_a_run(spark, tmp_path):
    made = [(i, 1, "m", 1, "common" + (" rare" if i % 200 == 0 else "") + (" last" if i == 2999 else "")) for i in range(3000)]
    folder, df = f"file://{tmp_path}/index", spark.createDataFrame(made, SCHEMA).coalesce(1)
    m = text_index.add(df, folder, KEYS)
    blocks = spark.read.parquet(f"{folder}/segments/{m.segments[0]}/postings")
    assert {(r.term, r.n, r.df) for r in blocks.groupBy("term").agg(F.count("*").alias("n"), F.sum("df").alias("df")).collect()} == {("common", 24, 3000), ("rare", 1, 15), ("last", 1, 1)}
    text_index.delete(spark, folder, df.where("doc_id = 400").select("doc_id"))
    left = df.where("doc_id <> 400")
    for query in (["rare", "last"], ["common", "rare"]):
        assert found(spark, folder, query, 20) == plain(left, query, 20)
