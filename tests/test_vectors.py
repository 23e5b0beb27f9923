"""The stored vector index: recall against brute force, filters, and folders that a query doesn't read."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import vector_index

SCHEMA = "vec_id long, embedding array<float>, owner int"


def clustered(n=3000, d=24, groups=50, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    return (middle[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, d))).astype(np.float32)


def test_recall_and_pruning(spark, tmp_path):
    x, folder = clustered(), f"file://{tmp_path}/vectors"
    odd = [(-1, None, 0), (-2, [0.0] * 24, 0), (-3, [math.nan] * 24, 0), (-4, [1.0], 0), (-5, [None] * 24, 0)]
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)] + odd, SCHEMA)
    index = vector_index.build(df, folder, "vec_id")
    assert index.probes <= len(index.centroids) / 3
    stored = spark.read.parquet(f"{folder}/lists")
    assert stored.count() == len(x)
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for i in range(0, len(x), 500):
        s = unit @ unit[i]
        want = np.argsort(-s)[:10]
        got = vector_index.search(spark, folder, "vec_id", x[i].tolist(), 10).orderBy("rank").collect()
        hits += len(set(want.tolist()) & {r["vec_id"] for r in got})
        assert all(abs(r["cosine"] - s[r["vec_id"]]) < 1e-5 for r in got)
    assert hits >= 0.95 * 60
    mine = vector_index.search(spark, folder, "vec_id", x[0].tolist(), 10, F.col("owner") == 1).collect()
    assert len(mine) == 10 and all(r["vec_id"] % 3 == 1 for r in mine)
    plan = stored.where(F.col("list").isin([1, 2])).select("code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_nothing_to_index(spark, tmp_path):
    assert vector_index.build(spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], SCHEMA), f"file://{tmp_path}/v", "vec_id") is None
    assert vector_index.build(spark.createDataFrame([(1, [2.0, 0.0], 0)], SCHEMA), f"file://{tmp_path}/v", "vec_id").probes == 1
    assert [tuple(r) for r in vector_index.search(spark, f"file://{tmp_path}/v", "vec_id", [1.0, 0.0], 5).collect()] == [(1, 1.0, 1)]


def test_search_is_exact_where_lists_and_codes_are_poor(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    x, folder = rng.normal(size=(3000, 32)).astype(np.float32), f"file://{tmp_path}/vectors"
    x[::7] *= 1 + rng.random((len(x[::7]), 32)).astype(np.float32) ** 8 * 6  # far from the sample's residuals: their codes are clipped
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)], SCHEMA)
    vector_index.build(df, folder, "vec_id", recall=0.3, sample=200)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for i, most in ((1, 10_000), (7, 10_000), (14, 5)):
        monkeypatch.setattr(vector_index, "MOST_LOOKUPS", most)
        want = np.argsort(-(unit @ unit[i]), kind="stable")
        assert [r["vec_id"] for r in vector_index.search(spark, folder, "vec_id", x[i].tolist(), 10).orderBy("rank").collect()] == want[:10].tolist()
    few = vector_index.search(spark, folder, "vec_id", x[0].tolist(), 10, F.col("vec_id") < 4).orderBy("rank").collect()  # fewer than k
    assert [r["vec_id"] for r in few] == [j for j in np.argsort(-(unit @ unit[0]), kind="stable").tolist() if j < 4]
