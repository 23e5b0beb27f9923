"""What the operators of this subpackage share: work folder, text helpers, components."""

from __future__ import annotations

import ctypes
import os
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: The white space of every contract here: space and \x09 to \x0D, which is what bytes.split() uses.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

LOWEST = -(2**63)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small, since one text may be very long."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder (as URI) below spark.checkpoint.dir, which driver and executors share.

    Where the session has no such setting, a session that runs in one JVM gets a folder below /tmp/checkpoints; a cluster, whose
    machines don't share one, gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    whole = f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole
    return f"{whole.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The size of df's input as the optimizer estimates it from its files; where it can't, the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def parts_for(df: DataFrame, target: int) -> int:
    """How many partitions of about `target` input bytes df should have; never fewer than the cluster has cores."""
    n = -(-input_bytes(df) // target)
    return int(max(df.sparkSession.sparkContext.defaultParallelism, min(n, 1_000_000)))


def let_go() -> None:
    """Give freed memory back to the system, since a worker process lives on through later tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    LIMIT = 600_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES: list[WordHashes] = []


def word_hashes() -> WordHashes:
    """This Python worker's table."""
    if not _HASHES:
        _HASHES.append(WordHashes())
    return _HASHES[0]


def forget_words() -> None:
    """Drop this worker's table at the end of a task: idle workers would hold it through all later stages."""
    _HASHES.clear()
    let_go()


def words_of(text: str | None, lower: bool) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the graph with edges a-b; the roots themselves are left out."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def _local_forest(batches):
    for pdf in batches:
        if len(pdf):
            child, root = forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            yield pd.DataFrame({"a": child, "b": root})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star steps. Each keeps at most as many edges as it was given, joins on
    keys whose hot sides Spark may split, and writes its edges to the shared folder, so a lost executor costs
    one step. Ends when a step changes nothing. No edges: no rows. Self-loops and repeated edges are harmless.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = written(e.mapInPandas(_local_forest, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        # large star: each node links its larger neighbours to its smallest neighbour
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node links itself and its smaller neighbours to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = written(small.where("a <> b").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
