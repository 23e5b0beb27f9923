"""The pipeline's stages on a small corpus, each against what it must keep and drop."""

import random

import pytest

from tests.llm.helpers import SCHEMA, prose

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(4)
    line, bench = "Some line that many of the documents repeat.", prose(rng, 50, tag="bench")
    rows = [(i, prose(rng, 60, vocabulary=5000), "en", "s", 0) for i in range(80)]
    rows += [(100 + i, f"{prose(rng, 60, vocabulary=5000)}\n{line}", "en", "s", 0) for i in range(4)]
    rows += [(200 + i, rows[0][1] + (" end" if i else ""), "en", "s", 0) for i in range(3)]
    rows += [(300, f"{rows[1][1][::-1]} {bench}", "en", "s", 0)]
    rows += [(400 + i, " ".join(w.upper() + "###" for w in prose(rng, 50).split()), "en", "s", 0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 400), 0) for r in rows if r[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == list(cp.COLUMNS), name
        if k == 1:
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert [line in kept[100 + i] for i in range(4)] == [False, False, False, True]
    everything = {r[0] for r in rows}
    assert seen[0] == {i for i in everything if i < 400}
    assert seen[1] == seen[0]
    assert seen[2] == seen[1] - {200, 201, 202}
    assert seen[3] == seen[2] - {300}
    assert seen[4] == seen[3]
    assert {(r["doc_id"], r["piece"], r["length"]) for r in cp.run(spark, str(tmp_path)).collect()} == {(r["doc_id"], r["piece"], r["length"]) for r in docs.collect()}


def test_stages_judge_rows_whose_ids_are_null_or_repeat(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(7)
    a, b, c, d, bench = [prose(rng, 60, vocabulary=5000) for _ in range(4)] + [prose(rng, 50, tag="bench")]
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in df.collect())
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)

    grouped = make([(None, a), (None, a), (None, a + " end"), (4, a), (None, b), (7, c), (7, d), (2, d), (8, None), (None, None), (None, "")])
    got = texts(cp.keep_one_of_each_group(spark, grouped.where("text is not null"), str(tmp_path)))
    assert [i for i, _ in got] == [-1, -1, -1, 2, 7] and {t.removesuffix(" end") for _, t in got} == {a, b, c, d, ""}
    assert cp.keep_one_of_each_group(spark, grouped, str(tmp_path)).count() == 7

    mixed = make([(None, f"{a} {bench}"), (None, b), (5, f"{c} {bench}"), (5, d), (6, None), (6, "")])
    out = cp.drop_benchmark_passages(spark, mixed, str(tmp_path))
    assert out.columns == list(cp.COLUMNS)
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(None, b), (5, d), (6, None), (6, "")}


def test_stages_of_nothing_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rng = random.Random(3)
    rows = [(1, prose(rng, 40), "en", "s", 0), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    clash = {c: F.lit(c) for c in ("score", "predicted", "n_lines", "n_dropped", "component_id", "n_shingles", "item_id", "__p", "row")}
    for made, n in (([], 0), (rows, 4)):
        docs = spark.createDataFrame(made, SCHEMA).withColumns(clash)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() == n, name
            if name != "best-fit packing":
                assert out.columns == docs.columns and all(r["score"] == "score" and r["row"] == "row" and r["n_lines"] == "n_lines" for r in out.collect())
                docs = out
