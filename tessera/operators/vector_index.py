"""A stored vector index: inverted lists with residual codes, one folder for each list, so that a query reads a few folders.

Unit vectors are dealt to the nearest of about sqrt(n) centroids. A list's rows hold the vector and a code, one byte for each dimension of
what the centroid leaves. A query takes the lists whose centroids are nearest, scores their codes, and compares the best
candidates by exact cosine. How many lists a query takes first is measured when the index is built, on queries from its sample. What they
give is a bound: other lists are read only if their radius lets them reach it, and vectors only if their code does, so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import cosine, ranked

MOST_LISTS, SAMPLE, ROUNDS = 4096, 20_000, 12
#: Queries that measure how many lists are needed, and neighbours that each of them looks for.
TRIALS, TRIAL_K = 200, 10
#: Vectors that a search may look up by key; where more can be results, it compares the lists' vectors in place.
MOST_LOOKUPS = 10_000


@dataclass(frozen=True)
class Lists:
    """Centroids, the step of the codes, how many lists a query reads first, and how far each list's vectors are from its centroid at most."""

    centroids: np.ndarray
    step: float
    probes: int
    radius: np.ndarray | None = None


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def fit(sample: np.ndarray, lists: int, recall: float, seed: int = 5) -> Lists:
    """Spherical k-means on the sample's unit vectors; `probes` finds a share `recall` of the neighbours of all trial queries."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        alive = np.bincount(own, minlength=lists) > 0
        c = np.where(alive[:, None], _unit(sums), c)
    own = np.argmax(x @ c.T, axis=1)
    step = float(np.abs(x - c[own]).max()) / 127 or 1.0
    trials = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    near = np.argsort(-(x[trials] @ x.T), axis=1)[:, : TRIAL_K + 1]
    order = np.argsort(-(x[trials] @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Lists(c, step, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)


def _usable() -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)


def build(vectors: DataFrame, folder: str, key: str, recall: float = 0.99, sample: int = SAMPLE) -> Lists | None:
    """Write the index of vectors (key, embedding, further columns) below `folder`; every usable vector is in it.

    Null and zero vectors and those with null or non-finite entries are left out, as are vectors whose length isn't the most frequent one.
    Centroids are fitted on `sample` vectors of smallest key hash; they go to the tasks, at most MOST_LISTS of them.
    """
    spark = vectors.sparkSession
    rows = vectors.where(_usable())
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    rows = rows.where(F.size("embedding") == size["d"])
    lists = int(min(MOST_LISTS, max(1, round(size["count"] ** 0.5))))
    taken = np.array([r[0] for r in rows.select("embedding", F.xxhash64(key).alias("h")).orderBy("h").limit(sample).select("embedding").collect()], np.float64)
    index = fit(taken, min(lists, len(taken)), recall)
    c, step = index.centroids, index.step
    names = [f.name for f in rows.schema]

    def place(batches):
        for b in batches:
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            x = _unit(v)
            own = np.argmax(x @ c.T, axis=1)
            left = x - c[own]
            code = np.clip(np.rint(left / step), -127, 127).astype(np.int8)
            off, far = (pa.array(np.linalg.norm(r, axis=1)) for r in (left - step * code, left))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in code], pa.binary()), off, far, pa.array(own.astype(np.int32))], names=[*names, "code", "off", "far", "list"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(place, f"{schema}, code binary, off double, far double, list int")
    dealt.repartitionByRange("list", F.xxhash64(key)).sortWithinPartitions("list", key).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    radius = np.zeros(len(c))
    for r in spark.read.parquet(f"{folder}/lists").groupBy("list").agg(F.max("far").alias("far")).collect():  # at most MOST_LISTS rows
        radius[r["list"]] = r["far"]
    spark.createDataFrame([(i, [float(x) for x in v], step, index.probes, float(radius[i])) for i, v in enumerate(c)], "list int, centroid array<double>, step double, probes int, radius double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    return replace(index, radius=radius)


def load(spark: SparkSession, folder: str) -> Lists:
    rows = sorted(spark.read.parquet(f"{folder}/centroids").collect(), key=lambda r: r["list"])  # at most MOST_LISTS rows
    return Lists(np.array([r["centroid"] for r in rows]), rows[0]["step"], rows[0]["probes"], np.array([r["radius"] for r in rows]))


def search(spark: SparkSession, folder: str, key: str, query: list[float], k: int, allowed: Column | None = None, probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """key, cosine and rank of the k nearest allowed vectors; with `probes`, of those in so many lists only.

    The filter comes before anything is dropped. First the codes alone of the lists measured when the index was built are read; the
    `candidates` (2 k) best of them are compared by their vectors. The k-th best cosine is what others must reach: a vector's is at most its
    list's plus the radius, and what its code gives plus what the code leaves (`off`). Codes of all lists that can reach it are read,
    and the vectors whose codes can are compared, so no neighbour is missed.
    """
    index, most = load(spark, folder), candidates or 2 * k
    q = np.array(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    near, step = index.centroids @ q, index.step
    rows = spark.read.parquet(f"{folder}/lists")
    rows = rows if allowed is None else rows.where(allowed)
    kind = rows.schema[key].dataType.simpleString()

    def about(b: pa.RecordBatch) -> np.ndarray:
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1)
        return near[b.column("list").to_numpy()] + step * (code @ q)

    def best_of(batches):
        for b in batches:
            if b.num_rows:
                s = about(b)
                best = pa.array(np.argsort(-s, kind="stable")[:most])
                yield pa.RecordBatch.from_arrays([b.column(key).take(best), b.column("list").take(best), pa.array(s).take(best)], names=[key, "list", "about"])

    def exact(some: DataFrame) -> DataFrame:
        return ranked(some.select(key, cosine(F.col("embedding"), query).alias("cosine")), "cosine", [key], k)

    def looked_up(found: list) -> DataFrame:
        return exact(rows.where(F.col("list").isin(sorted({r["list"] for r in found})) & F.col(key).isin(sorted({r[key] for r in found}))))

    wanted = [int(i) for i in np.argsort(-near, kind="stable")[: probes or index.probes]]
    codes = rows.where(F.col("list").isin(wanted)).select(key, "list", "code")
    first = looked_up(codes.mapInArrow(best_of, f"`{key}` {kind}, list int, about double").orderBy(F.desc("about"), key).limit(most).collect())
    if probes is not None:
        return first
    best = first.collect()  # k rows
    needed = min(r["cosine"] for r in best) - 2e-9 if len(best) == k else -2.0

    def reaching(batches):
        for b in batches:
            if b.num_rows:
                can = pa.array(np.flatnonzero(about(b) + b.column("off").to_numpy() >= needed))
                yield pa.RecordBatch.from_arrays([b.column(key).take(can), b.column("list").take(can)], names=[key, "list"])

    able = rows.where(F.col("list").isin([int(i) for i in np.flatnonzero(near + index.radius >= needed)]))
    found = able.select(key, "list", "code", "off").mapInArrow(reaching, f"`{key}` {kind}, list int").limit(MOST_LOOKUPS + 1).collect() if len(best) == k else None
    return exact(able) if found is None or len(found) > MOST_LOOKUPS else looked_up(found)
