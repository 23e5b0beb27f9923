"""A stored inverted index: immutable segments, deletes as tombstones, and top-k search that reads few blocks.

Folders below the index: `manifest/` holds one small file for each version, the highest is the index; `segments/<id>/` and
`deletes/<id>/` hold Parquet tables that are never changed. A version names the segments and deletes it consists of, so readers of
an older version aren't disturbed, and a writer that another one overtook gets an error.

A segment's chunks get numbers by tile, TILE chunks at a time in the order in which they are read. Its tables:
* chunks (tile, at, keys and further columns, dl, terms with repeats, joined by a space): the forward form, which deletes and compaction need;
* postings (term, tile, span, at, tf, dl, df, max_tf, min_dl): a block of a term's postings in `span` tiles from `tile` on, where `at`
  counts from. A task turns its chunks into blocks, about RUN_TERMS terms at a time, each run sorted by term and tile, so nothing is
  shuffled and a search reads a few pages of each run. A term of more than WIDE postings in a run has a block for each tile (two
  where a tile is read in two parts), one of fewer has one for all. max_tf and min_dl bound what the block can add to a score, whatever
  the mean length has become; df counts its postings.
A delete's tables are dead (segment, tile, at) and terms with negative df.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import n_terms, term_line
from tessera.operators.retrieval import K1, B, ranked
from tessera.sources.shared import latest, publish

TILE = 128
#: Terms that a task turns into blocks at a time, and blocks in a batch that it hands back.
RUN_TERMS, BATCH_BLOCKS = 2_000_000, 50_000
#: Postings of a term in a run up to which they are one block, whatever their tiles.
WIDE = 256
BLOCK = "term string, tile long, span int, at array<int>, tf array<int>, dl array<int>, df int, max_tf int, min_dl int"
#: Deleted chunks up to which a delete broadcasts their numbers, so that other chunks' terms stay where they are.
FEW_DEAD = 1_000_000
#: Tiles that a search reads first, to learn what score is needed.
FIRST_TILES = 64


@dataclass(frozen=True)
class Manifest:
    """One version: the segments and deletes in it, live chunks, the sum of their lengths, the columns that identify a chunk."""

    version: int = 0
    keys: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    chunks: int = 0
    length: int = 0


def manifest(spark: SparkSession, folder: str) -> Manifest:
    """The current version; an empty one where there is no index."""
    _, text = latest(spark, folder)
    return Manifest() if text is None else Manifest(**json.loads(text))


def _publish(spark: SparkSession, folder: str, new: Manifest) -> Manifest:
    publish(spark, folder, new.version, json.dumps(new.__dict__))
    return new


def _run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of some chunks (tile, at, dl, terms), sorted by term and tile."""
    t = pa.Table.from_batches(batches).combine_chunks()
    if not t.num_rows:
        return
    each = pc.split_pattern(pa.concat_arrays(t["terms"].chunks), " ").flatten().dictionary_encode()
    order = pc.sort_indices(each.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    row = np.repeat(np.arange(t.num_rows), t["dl"].to_numpy())
    pairs, tf = np.unique(place[each.indices.to_numpy()] * t.num_rows + row, return_counts=True)
    term, row = np.divmod(pairs, t.num_rows)
    tile, tf = t["tile"].to_numpy()[row], tf.astype(np.int32)
    at, dl = t["at"].to_numpy()[row], t["dl"].to_numpy()[row]
    often = (np.bincount(term) > WIDE)[term[1:]]
    writer = tile >> (33 - 7)  # numbers of one task's chunks are dense, those of others far away
    start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (writer[1:] != writer[:-1]) | (often & (tile[1:] != tile[:-1]))])
    ends = np.r_[start[1:], len(pairs)]
    first, last = np.minimum.reduceat(tile, start), np.maximum.reduceat(tile, start)
    at = ((tile - np.repeat(first, ends - start)) * TILE + at).astype(np.int32)
    most, least = np.maximum.reduceat(tf, start), np.minimum.reduceat(dl, start)
    names = each.dictionary.take(order)
    for i in range(0, len(start), BATCH_BLOCKS):
        own = slice(i, i + BATCH_BLOCKS)
        here = slice(start[own][0], ends[own][-1])
        offsets = pa.array(np.r_[start[own], ends[own][-1]] - here.start, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[here])) for x in (at, tf, dl)]
        numbers = [pa.array(x[own]) for x in ((ends - start).astype(np.int32), most, least)]
        where = [pa.array(first[own]), pa.array((last - first + 1)[own].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(term[start[own]])), *where, *lists, *numbers], names=["term", "tile", "span", "at", "tf", "dl", "df", "max_tf", "min_dl"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += pc.sum(b.column("dl")).as_py() or 0
        if n >= RUN_TERMS:
            yield from _run(held)
            held, n = [], 0
    if held:
        yield from _run(held)


def _write_segment(rows: DataFrame, folder: str) -> DataFrame:
    """The tables of a segment of rows (dl, terms and all other columns of chunks); returns the chunks as stored."""
    number = F.monotonically_increasing_id()
    numbered = rows.select(F.shiftright(number, 7).alias("tile"), F.pmod(number, F.lit(TILE)).cast("byte").alias("at"), "*")
    numbered.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    stored = rows.sparkSession.read.parquet(f"{folder}/chunks")
    blocks = stored.where("dl > 0").select("tile", "at", "dl", "terms").mapInArrow(_blocks, BLOCK)
    blocks.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")
    return stored


def add(chunks: DataFrame, folder: str, keys: list[str] | None = None) -> Manifest:
    """Add chunks (keys, content, further columns) as a new segment; the first call makes the index.

    Chunks without terms count, but have no postings. The texts are read once and nothing is shuffled. A chunk that is
    there already is added again: delete first to replace.
    """
    spark = chunks.sparkSession
    now = manifest(spark, folder)
    keys = now.keys or list(keys or [])
    name = uuid.uuid4().hex
    t = chunks.withColumn("terms", term_line(F.coalesce("content", F.lit("")))).drop("content").withColumn("dl", n_terms(F.col("terms")))
    n, length = _write_segment(t, f"{folder}/segments/{name}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return _publish(spark, folder, Manifest(now.version + 1, keys, [*now.segments, name], now.deletes, now.chunks + n, now.length + length))


def _tables(spark: SparkSession, folder: str, names: list[str], table: str, kind: str = "segments") -> DataFrame | None:
    """The rows of a table of all segments (or deletes), with `segment`."""
    out = None
    for name in names:
        df = spark.read.parquet(f"{folder}/{kind}/{name}/{table}").withColumn("segment", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def live(spark: SparkSession, folder: str, m: Manifest | None = None) -> DataFrame | None:
    """The chunk rows that no delete has taken."""
    m = m or manifest(spark, folder)
    rows = _tables(spark, folder, m.segments, "chunks")
    dead = _tables(spark, folder, m.deletes, "dead", "deletes")
    return rows if rows is None or dead is None else rows.join(dead.select("home", "tile", "at"), [rows["segment"] == dead["home"], rows["tile"] == dead["tile"], rows["at"] == dead["at"]], "left_anti")


def deleted(spark: SparkSession, folder: str, m: Manifest | None = None) -> int:
    """How many chunks deletes have taken that no compaction has cleared yet."""
    dead = _tables(spark, folder, (m or manifest(spark, folder)).deletes, "dead", "deletes")
    return 0 if dead is None else dead.count()


def delete(spark: SparkSession, folder: str, gone: DataFrame) -> Manifest:
    """Take all chunks out whose columns agree with a row of `gone` (say, file_md5): tombstones, and the statistics they change."""
    m = manifest(spark, folder)
    rows = live(spark, folder, m)
    if rows is None:
        return m
    name = uuid.uuid4().hex
    own = f"{folder}/deletes/{name}"
    keys = rows.select(F.col("segment").alias("home"), "tile", "at", "dl", *gone.columns)  # terms aren't shuffled to find what goes
    keys.join(gone.distinct(), gone.columns, "left_semi").drop(*gone.columns).write.parquet(f"{own}/dead")
    taken = spark.read.parquet(f"{own}/dead")
    n, length = taken.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not n:
        return m
    tiles = taken.groupBy(F.col("home").alias("segment"), "tile").agg(F.collect_list("at").alias("gone"))
    every = _tables(spark, folder, m.segments, "chunks").where("dl > 0").select("segment", "tile", "at", "terms")
    lost = every.join(F.broadcast(tiles) if n <= FEW_DEAD else tiles, ["segment", "tile"]).where(F.array_contains("gone", F.col("at")))
    less = lost.select(F.explode(F.array_distinct(F.split("terms", " "))).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
    less.sortWithinPartitions("term").write.parquet(f"{own}/terms")
    return _publish(spark, folder, Manifest(m.version + 1, m.keys, m.segments, [*m.deletes, name], m.chunks - n, m.length - length))


def compact(spark: SparkSession, folder: str) -> Manifest:
    """One segment of what is live, without tombstones; made from the forward rows, texts aren't needed."""
    m = manifest(spark, folder)
    rows = live(spark, folder, m)
    if rows is None:
        return m
    name = uuid.uuid4().hex
    _write_segment(rows.drop("tile", "at", "segment"), f"{folder}/segments/{name}")
    return _publish(spark, folder, Manifest(m.version + 1, m.keys, [name], [], m.chunks, m.length))


def _each(blocks: DataFrame) -> DataFrame:
    """A row for each posting of the blocks: segment, term, tile, at, tf, dl."""
    p = blocks.select("segment", "term", "tile", F.explode(F.arrays_zip("at", "tf", "dl")).alias("p"))
    return p.select("segment", "term", (F.col("tile") + F.shiftright("p.at", 7)).alias("tile"), F.col("p.at").bitwiseAND(TILE - 1).cast("byte").alias("at"), "p.tf", "p.dl")


def search(spark: SparkSession, folder: str, query: list[str], k: int, allowed: Column | None = None, read: dict | None = None) -> DataFrame:
    """The k chunks of highest BM25 that are live and allowed: all stored columns, bm25 and rank, as retrieval.ranked orders them.

    Statistics are those of all live chunks. First the bounds of blocks of one tile (no postings) and the others' few postings are read and summed by tile, which gives
    the most that a chunk of the tile can score. The FIRST_TILES best tiles are scored; their k-th best score is what others must
    reach, and only tiles whose bound does are read after that. Skipped tiles can't hold a result, so the rows are those of
    a full scan. `read`, if given, is told the number of tiles with a term and of those scored.
    """
    m, query = manifest(spark, folder), sorted(set(query))
    here = lambda df: df.where(F.col("term").isin(query))
    chunks, postings = _tables(spark, folder, m.segments, "chunks"), _tables(spark, folder, m.segments, "postings")
    if postings is None or not query or not m.chunks:
        empty = chunks.drop("terms", "segment", "tile", "at", "dl").limit(0) if chunks is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in m.keys or ["chunk"]))
        return empty.withColumns({"bm25": F.lit(0.0), "rank": F.lit(0)})
    own = here(postings)
    counted = [x for x in (postings, _tables(spark, folder, m.deletes, "terms", "deletes")) if x is not None]
    df = {}
    for x in counted:
        for r in here(x).groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each query term
            df[r["term"]] = df.get(r["term"], 0) + r["df"]
    n, mean = float(m.chunks), m.length / m.chunks or 1.0
    idf = F.lit(0.0)
    for q, c in df.items():
        idf = F.when(F.col("term") == q, F.log(1 + (F.lit(n) - F.lit(float(c)) + 0.5) / (F.lit(float(c)) + 0.5))).otherwise(idf)
    part = lambda tf, dl: idf * tf / (tf + K1 * (1 - B + B * dl / F.lit(mean)))

    one, wide = own.where("span = 1"), _each(own.where("span > 1"))

    def scored(one: DataFrame, tiles: DataFrame, few: bool) -> DataFrame:
        in_tiles = lambda df: df.join(F.broadcast(tiles) if few else tiles, ["segment", "tile"], "left_semi")
        each = _each(in_tiles(one)).unionByName(in_tiles(wide))
        hits = each.groupBy("segment", "tile", "at").agg(F.sum(part(F.col("tf"), F.col("dl"))).alias("bm25"))
        rows = in_tiles(chunks.drop("terms")) if few else chunks.drop("terms")
        rows = rows if allowed is None else rows.where(allowed)
        out = hits.join(rows, ["segment", "tile", "at"])
        dead = _tables(spark, folder, m.deletes, "dead", "deletes")
        if dead is not None:
            out = out.join(dead.select(F.col("home").alias("segment"), "tile", "at"), ["segment", "tile", "at"], "left_anti")
        return ranked(out.drop("segment", "tile", "at", "dl"), "bm25", m.keys, k)

    most = one.select("segment", "tile", part(F.col("max_tf"), F.col("min_dl")).alias("most"))
    best_of = wide.groupBy("segment", "tile", "term").agg(F.max(part(F.col("tf"), F.col("dl"))).alias("most")).drop("term")
    bounds = most.unionByName(best_of).groupBy("segment", "tile").agg(F.sum("most").alias("most"))
    first = bounds.orderBy(F.desc("most"), "segment", "tile").limit(FIRST_TILES).collect()
    few = spark.createDataFrame(first, "segment string, tile long, most double")
    in_few = F.col("tile").isin([r["tile"] for r in first])
    top = scored(one.where(in_few), few, True)
    best = top.collect()  # k rows
    needed = best[-1]["bm25"] - 2e-9 if len(best) == k else 0.0
    last = min((r["most"] for r in first), default=0.0)
    rest = 0
    out = spark.createDataFrame(best, top.schema)
    if len(first) == FIRST_TILES and last >= needed:
        others = bounds.join(F.broadcast(few), ["segment", "tile"], "left_anti").where(F.col("most") >= needed).select("segment", "tile")
        rest = others.count()
        if rest:
            # no bound on their number is known here: Spark decides how to join them
            more = scored(one, others, False)
            out = ranked(out.drop("rank").union(more.drop("rank")), "bm25", m.keys, k)
    if read is not None:
        read |= {"tiles": bounds.count(), "scored": len(first) + rest}
    return out
