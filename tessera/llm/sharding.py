"""Sharding by histogram sort: probe, count exactly, refine, exchange once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import LOWEST, prepare, written

BINS = T.StructType(
    [T.StructField("bin", T.IntegerType())]
    + [T.StructField(x, T.LongType()) for x in ("bytes", "lo_h", "lo_d", "hi_h", "hi_d")]
)


def _whole(h: int, d: int) -> int:
    """A (text hash, doc_id) pair as one unsigned 128-bit number in the same order."""
    return ((h - LOWEST) << 64) | (d - LOWEST)


def _pair(key: int) -> tuple[int, int]:
    return (key >> 64) + LOWEST, (key & (2**64 - 1)) + LOWEST


def _bin_of(h: np.ndarray, d: np.ndarray, ph: np.ndarray, pd_: np.ndarray) -> np.ndarray:
    """How many of the sorted probes (ph, pd_) are <= each key (h, d)."""
    left, right = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = left.astype(np.int64)
    equal = np.flatnonzero(right > left)
    for at in np.unique(left[equal]):  # one step for each hash that is a probe's, however many rows have it
        own = equal[left[equal] == at]
        out[own] = at + np.searchsorted(pd_[at : right[own[0]]], d[own], "right")
    return out


def _histogram(probes: list[int]):
    ph, pd_ = (np.array(x, np.int64) for x in zip(*map(_pair, probes), strict=True))

    def run(batches):
        for b in batches:
            if len(b):
                b = b.assign(bin=_bin_of(b["h"].to_numpy(), b["d"].to_numpy(), ph, pd_)).sort_values(["h", "d"], kind="stable")
                g = b.groupby("bin")
                first, last = g.first(), g.last()
                yield pd.DataFrame({"bin": first.index.astype("int32"), "bytes": g["size"].sum().to_numpy(), "lo_h": first["h"].to_numpy(), "lo_d": first["d"].to_numpy(), "hi_h": last["h"].to_numpy(), "hi_d": last["d"].to_numpy()})

    return run


def _bins(keys: DataFrame, probes: list[int]) -> tuple[dict, list[int]]:
    """(rows of BINS by bin, exact bytes below each probe), counted over all partitions in one pass."""
    low, high = F.min(F.struct("lo_h", "lo_d")).alias("low"), F.max(F.struct("hi_h", "hi_d")).alias("high")
    rows = keys.mapInPandas(_histogram(probes), BINS).groupBy("bin")
    bins = {r["bin"]: r for r in rows.agg(F.sum("bytes").alias("bytes"), low, high).collect()}  # a row for each candidate
    below = [0]
    for i in range(len(probes)):
        below.append(below[-1] + (bins[i]["bytes"] if i in bins else 0))
    return bins, below[1:]


def splitters(keys: DataFrame, n: int, tolerance: float = 0.01, probes_each: int = 16) -> list[int]:
    """n - 1 splitters (as whole keys) that cut keys (h, d, size) into n ranges of near-equal bytes.

    Each round counts the exact bytes below all candidate keys over all partitions (what comes back is at most
    n * (probes_each + 4) rows), and puts new candidates only into the interval that holds the wanted cut.
    Candidates lie between groups of equal texts until an interval holds a single group; only such a group is cut, by
    doc_id. A splitter is settled within `tolerance` of a range's bytes, or when a single key is left. Last, a cut through a group
    that is no larger than a range moves to the nearer edge of the group.
    """
    total = keys.agg(F.sum("size").cast("long")).first()[0]
    if not total or n < 2:
        return []
    want = [total * i / n for i in range(1, n)]
    slack = tolerance * total / n
    found: dict[int, int] = {}
    probes = sorted({_whole(LOWEST + (i << 64) // (n * probes_each), LOWEST) for i in range(1, n * probes_each)})
    while len(found) < n - 1:
        bins, below = _bins(keys, probes)
        edges = np.array(below, dtype=np.float64)
        fresh: set[int] = set()
        for k, w in enumerate(want):
            if k in found:
                continue
            i = int(np.searchsorted(edges, w, "left"))  # the bin that holds the cut
            near = min((j for j in (i - 1, i) if 0 <= j < len(probes)), key=lambda j: abs(edges[j] - w))
            if abs(edges[near] - w) <= slack:
                found[k] = probes[near]
                continue
            r = bins[i]
            lo, hi = _whole(*r["low"]), _whole(*r["high"])
            if lo == hi:  # a single key: the nearer of its two sides
                start = below[i - 1] if i else 0
                found[k] = lo + (w - start > start + r["bytes"] - w)
            elif lo >> 64 != hi >> 64:
                a, b = (lo >> 64), (hi >> 64) + 1
                fresh |= {(a + (b - a) * j // (probes_each + 1)) << 64 for j in range(1, probes_each + 1)} | {(a + 1) << 64, (b - 1) << 64, a << 64, b << 64}
            else:
                fresh |= {lo + (hi + 1 - lo) * j // (probes_each + 1) for j in range(1, probes_each + 1)} | {lo, lo + 1, hi, hi + 1}
        probes = sorted(p for p in fresh if 0 < p < 2**128)
    return sorted(_at_group_edges(keys, list(found.values()), want, total / n))


def _at_group_edges(keys: DataFrame, cuts: list[int], want: list[float], whole: float) -> list[int]:
    inside = [c for c in cuts if c & (2**64 - 1)]
    probes = sorted({e for c in inside for e in ((c >> 64) << 64, min(((c >> 64) + 1) << 64, 2**128 - 1)) if e > 0})
    if not probes:
        return cuts
    below = dict(zip(probes, _bins(keys, probes)[1], strict=True))
    out = []
    for c, w in zip(sorted(cuts), want, strict=True):
        first, behind = (c >> 64) << 64, min(((c >> 64) + 1) << 64, 2**128 - 1)
        if c & (2**64 - 1) and below[behind] - below.get(first, 0) <= whole:
            c = min((first, behind), key=lambda e: abs(below.get(e, 0) - w))
        out.append(c)
    return out


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, range_bytes: int = 128 << 20) -> DataFrame:
    """All columns of docs plus size, law ('bytes'), shard, slot and grown_shard (null under this law).

    size: UTF-8 bytes of the text (null: none) plus 16. Documents are ordered by (hash of the text, doc_id) and cut
    into `shards` consecutive ranges of near-equal bytes, each cut within `tolerance` of a range or at a
    single document. Equal texts lie in one shard unless they fill more than a whole one; a cut that would go through them lies
    at the nearer of their edges. slot numbers the documents of a shard from 0 without gaps.

    Null text sorts as ''. Null doc_id sorts first. Repeated rows (same doc_id and text) share a shard and get
    a slot each. An empty table gives an empty table. Fewer documents than shards: some shards stay empty. Input
    columns of the new names are replaced.

    A shard larger than `range_bytes` is made of several parts, dealt by a hash of doc_id and text, so that no task holds a whole
    shard or a large group; the parts' row counts give each its first slot. The texts are exchanged once. The driver
    sees a row for each candidate, whose number depends on `shards` alone.
    """
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    key = {"__h": F.xxhash64(text), "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), "size": (F.octet_length(text) + 16).cast("long")}
    docs = docs.drop("law", "shard", "slot", "grown_shard", "size").withColumns(key)
    keys = written(docs.select(F.col("__h").alias("h"), F.col("__d").alias("d"), "size"), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * range_bytes)))
    cuts = splitters(keys, shards, tolerance)
    ch, cd = (np.array([_pair(min(c, 2**128 - 1))[i] for c in cuts], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def shard_of(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_bin_of(h.to_numpy(), d.to_numpy(), ch, cd).astype("int32"))

    part_of = lambda h, d: F.pmod(F.xxhash64(h, d), F.lit(parts)).cast("int").alias("__part")
    counts = keys.select(shard_of("h", "d").alias("shard"), part_of("h", "d")).groupBy("shard", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "bases")
    order = Window.partitionBy("shard", "__part").orderBy("__h", "__d")
    out = docs.withColumns({"shard": shard_of("__h", "__d"), "__part": part_of("__h", "__d")}).withColumn("__n", F.row_number().over(order))
    out = out.join(bases, ["shard", "__part"])
    new = {"law": F.lit("bytes"), "slot": F.col("__base") + F.col("__n") - 1, "grown_shard": F.lit(None).cast("int")}
    return out.withColumns(new).drop("__h", "__d", "__part", "__n", "__base")
