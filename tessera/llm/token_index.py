"""Token-id output: raw id payloads in shard files, keyed by a minimal perfect hash index with fingerprints.

Files of one output folder (any file system that pyarrow opens by URI):

payload-SSSSS-A.ids the ids of the shard's documents, one after the other, little-endian, `width` bytes each (2 where
                    the vocabulary fits, else 4), documents in ascending (doc_id, text hash) order
index-BBBBB-A.mph   for the keys of one hash bucket: levels of a minimal perfect hash function and, by slot, fingerprint,
                    shard, byte offset and id count

A is the number of the task attempt that wrote the file. Nothing is renamed: the tables `starts` and `index`, which hold only what
committed attempts returned, name the files that count, and a lost or repeated attempt's file is never read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import mix, parts_for, prepare, work_dir, written
from tessera.llm.encoding import encoder, gathered

MAGIC = b"TMPH1\0\0\0"
GAMMA = 2.0


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _create(uri: str):
    at, path = _open(uri)
    at.create_dir(path.rpartition("/")[0], recursive=True)
    return at.open_output_stream(path)


def _read(uri: str) -> bytes:
    at, path = _open(uri)
    with at.open_input_file(path) as f:
        return f.read()


def _keyed(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))


def build_mph(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(levels, slot of each key): distinct 64-bit keys onto 0..n-1.

    Each level is a bit array; a key whose bit is hit by no other key of the level rests there, the others go on. A
    key's slot is the number of set bits before its own, over all levels.
    """
    levels, left, slot, base, seed = [], np.arange(len(keys)), np.empty(len(keys), np.int64), 0, 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = (_keyed(keys[left], seed) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rests = alone[at]
        rank = np.cumsum(alone) - 1
        slot[left[rests]] = base + rank[at[rests]]
        base += int(alone.sum())
        levels.append(alone)
        left, seed = left[~rests], seed + 1
    return levels, slot


def find_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level takes it. A key never built in may get another key's slot."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for seed, bits in enumerate(levels):
        at = (_keyed(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[left[hit]] = base + rank[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_keyed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray) -> bytes:
    levels, slot = build_mph(keys)
    out = [MAGIC, struct.pack("<qq", len(keys), len(levels))]
    for bits in levels:
        out += [struct.pack("<q", len(bits)), np.packbits(bits).tobytes()]
    for values, kind in ((fingerprints(keys), "<u4"), (shard, "<u4"), (offset, "<u8"), (count, "<u8")):
        by_slot = np.empty(len(keys), kind)
        by_slot[slot] = values
        out.append(by_slot.tobytes())
    return b"".join(out)


def look_up(blob: bytes, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(found, shard, byte offset, id count) of each key; found is False where the stored fingerprint differs."""
    if blob[:8] != MAGIC:
        raise ValueError("not an index file")
    n, n_levels = struct.unpack_from("<qq", blob, 8)
    at, levels = 24, []
    for _ in range(n_levels):
        size = struct.unpack_from("<q", blob, at)[0]
        levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, -(-size // 8), at + 8), count=size).astype(bool))
        at += 8 + -(-size // 8)
    columns = []
    for kind in ("<u4", "<u4", "<u8", "<u8"):
        columns.append(np.frombuffer(blob, kind, n, at))
        at += columns[-1].nbytes
    slot = find_slots(levels, keys)
    safe = np.maximum(slot, 0)
    if not n:
        return np.zeros(len(keys), bool), *(np.zeros(len(keys), np.int64) for _ in range(3))
    found = (slot >= 0) & (columns[0][safe] == fingerprints(keys))
    return found, *(c[safe].astype(np.int64) for c in columns[1:])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_bytes: int = 24 << 20, keys_per_bucket: int = 200_000) -> dict:
    """Encode every text of docs into payload and index files in `folder`; returns what read_tokens() needs.

    Null or empty text: the end id alone. Rows with null doc_id are written, first of all, but have no key. Of rows
    that repeat a doc_id all are written and the first (by text hash) has the key. Extra columns are ignored.
    An empty table gives a folder without payloads. A lost task is run again and replaces its own files only.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or work_dir(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    parts = parts_for(docs, shard_bytes)

    def encode(batches):
        enc, shard, attempt = encoder(tokenizer), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        kind = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        width, at = np.dtype(kind).itemsize, 0
        with _create(f"{folder}/payload-{shard:05d}-{attempt}.ids") as out:
            for b in gathered(batches):
                ids, edges = enc.encode(b.column("text").combine_chunks(), end_id)
                out.write(ids.astype(kind))
                n = b.num_rows
                ints = [np.full(n, shard), at + width * edges[:-1], np.diff(edges), np.full(n, width), np.full(n, attempt)]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [b.column("doc_id").combine_chunks(), b.column("h").combine_chunks(), *(pa.array(c, k) for c, k in zip(ints, kinds, strict=True))]
                at += width * len(ids)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "shard", "offset", "count", "width", "attempt"])

    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    entries = written(ordered.mapInArrow(encode, "doc_id long, h long, shard int, offset long, count long, width int, attempt long"), "entries")
    width, n = entries.agg(F.max("width"), F.count("*")).first()
    buckets = max(1, -(-n // keys_per_bucket))
    once = entries.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("shard", "offset", "count")).alias("e"))
    keyed = once.select("doc_id", "e.*").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, attempt = int(pdf["bucket"].iloc[0]), TaskContext.get().taskAttemptId()
        blob = pack_index(*(pdf[c].to_numpy() for c in ("doc_id", "shard", "offset", "count")))
        with _create(f"{folder}/index-{bucket:05d}-{attempt}.mph") as out:
            out.write(blob)
        return pd.DataFrame({"bucket": [bucket], "keys": [len(pdf)], "bytes": [len(blob)], "attempt": [attempt]})

    index = written(keyed.groupBy("bucket").applyInPandas(build, "bucket int, keys long, bytes long, attempt long"), "index")
    shards = entries.groupBy("shard", "attempt").agg(F.sum("count").alias("n"))
    starts = written(shards.select("shard", "attempt", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start")), "starts")
    return {"folder": folder, "width": width or 2, "buckets": buckets, "starts": starts, "index": index, "entries": entries}


def read_tokens(files: dict, keys: DataFrame, ids: bool = False) -> DataFrame:
    """For each doc_id of keys that the files hold: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Each key costs one index probe and one read at a known place. Keys of one bucket share the load of its index file,
    those of one payload file that file's load; both are of bounded size. Unknown and null keys give no row.
    """
    prepare(keys.sparkSession)
    folder, width, buckets = files["folder"], files["width"], files["buckets"]

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        found, shard, offset, count = look_up(_read(f"{folder}/index-{pdf['bucket'].iloc[0]:05d}-{pdf['attempt'].iloc[0]}.mph"), pdf["doc_id"].to_numpy())
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "shard": shard.astype("int32"), "offset": offset, "count": count})[found]

    def fetch(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = _read(f"{folder}/payload-{pdf['shard'].iloc[0]:05d}-{pdf['attempt'].iloc[0]}.ids")
        crcs, lists = [], []
        for offset, count in zip(pdf["offset"], pdf["count"], strict=True):
            own = np.frombuffer(blob, f"<u{width}", count, offset).astype("<u4")
            crcs.append(zlib.crc32(own.tobytes()))
            lists.append(own.astype("int64") if ids else None)
        out = pdf[["doc_id", "shard_start", "offset", "count"]].assign(ids_crc32=crcs)
        return out.assign(ids=lists) if ids else out

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    wanted = wanted.join(files["index"].select("bucket", "attempt"), "bucket")  # buckets without a file hold no key
    placed = wanted.groupBy("bucket").applyInPandas(probe, "doc_id long, shard int, offset long, count long").join(files["starts"], "shard")
    fields = "doc_id long, shard_start long, offset long, count long, ids_crc32 long" + ", ids array<long>" * ids
    return placed.groupBy("shard").applyInPandas(fetch, fields).select("doc_id", (F.col("shard_start") + F.col("offset") / F.lit(width)).cast("long").alias("start"), F.col("count").alias("n_tokens"), "ids_crc32", *["ids"] * ids)
