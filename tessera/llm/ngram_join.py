"""N-gram Jaccard join by token-combination prefixes, with the components of its links.

A document's tokens are its distinct k-word shingles. All documents order tokens alike: by how often a sketch over the whole
corpus has counted them, rare ones first. Of two sets of similarity t or more, with n tokens each set's prefix of
n - ceil(t n) + 1 tokens shares a token with the other's. Only tokens that the sketch shows to be rare make index keys by
themselves. The others fall into classes, and within a class pairs of tokens are indexed. To still be certain, the prefix is
extended until (rare tokens) + sum over classes of (tokens - 1) reaches the plain prefix length: if no rare token and at most
one token of each class were shared, more tokens than n - ceil(t n) would be missing from the other set.

The larger a set, the more classes it takes (CLASSES), so that a class has few tokens in the prefix and few pairs. A number of
classes m serves sets of over ceil((m + 1) / t) tokens, which can always be extended far enough; sets below all of these are
indexed by single tokens. Keys of different numbers of classes never meet, so sets within a factor t above such a bound are
indexed on both sides of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWEST, components, forest, forget_words, input_bytes, let_go, mix, prepare, word_hashes, words_of, written

U = np.uint64
SLICES = 16
LEADERS = 8
#: Sets of a block, and about how many tokens they may have together.
BLOCK, BLOCK_TOKENS = 256, 300_000
#: Rows of one index key that one task takes; keys of more rows are spread.
SPREAD = 1000
#: Numbers of classes, each for sets up to the size from which the next one serves; 0: single tokens.
CLASSES = (0, 64, 256, 1024, 4096, 16384)


def shingle_sets(texts: list[str | None], k: int) -> list[tuple[int, np.ndarray]]:
    """(hash of the word sequence, sorted distinct shingle hashes) of each text; fewer than k words make one shingle."""
    import xxhash

    table, words = word_hashes(), [words_of(t, True) for t in texts]
    w = table.of([x for doc in words for x in doc])
    whole = np.zeros(max(0, len(w) - k + 1), U)
    c = 0x9E3779B97F4A7C15
    for j in range(k):
        whole += w[j : len(w) - k + 1 + j] * U(c) if len(w) >= k else whole
        c = (c * 0xD1342543DE82EF95) & (2**64 - 1) | 1
    whole = mix(whole)
    out, at = [], 0
    for doc in words:
        n = len(doc)
        joined = b" ".join(doc)
        if n >= k:
            tokens = np.unique(whole[at : at + n - k + 1])
        else:
            tokens = mix(np.array([xxhash.xxh3_64_intdigest(joined, seed=n)], U)) if n else np.empty(0, U)
        out.append((xxhash.xxh3_64_intdigest(joined) - (1 << 63), tokens))
        at += n
    return out


def _count(k: int, bits: int):
    """Rows of documents (doc_id, node, n), and at a task's end its part of the sketch, compressed, in slices."""

    def run(batches):
        import zstandard

        sketch, names = np.zeros(1 << bits, np.uint32), ["doc_id", "node", "n", "slice", "payload"]
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), k)
            seen, nodes = {}, []
            for node, tokens in sets:
                nodes.append(node)
                seen[node] = tokens
            some = np.concatenate([*seen.values(), np.empty(0, U)])
            np.add.at(sketch, (some & U((1 << bits) - 1)).astype(np.int64), np.uint32(1))  # in place: no second sketch
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(t) for _, t in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        forget_words()
        if sketch.any():
            parts = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(sketch, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _add_up(batches):
    """Rows sorted by slice: one row for each, with the sum of its parts; holds one slice at a time."""
    import zstandard

    d, now, total = zstandard.ZstdDecompressor(), None, None
    pack = zstandard.ZstdCompressor(level=1).compress

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack(total.tobytes())], pa.binary())], names=["slice", "payload"])

    for b in batches:
        for s, p in zip(b.column("slice").to_pylist(), b.column("payload").to_pylist(), strict=True):
            part = np.frombuffer(d.decompress(p), np.uint32)
            if s != now:
                if now is not None:
                    yield row()
                now, total = s, np.zeros(len(part), np.uint32)
            total = np.minimum(total.astype(np.uint64) + part, 2**32 - 1).astype(np.uint32)
    if now is not None:
        yield row()


def levels(counted: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """(level of each sketch cell: 8 * log2(1 + count), the highest level of rare tokens). 2**bits bytes.

    A cell counts its tokens' documents and some of other tokens, `mean` on average; a token is rare if it is alone in its cell or
    the cell has three deviations less than the mean.
    """
    import zstandard

    parts = counted.where("slice is not null").select("slice", "payload")
    for salt in (F.spark_partition_id() % 64, F.lit(0)):  # two steps, so that no task adds up what all tasks made
        parts = parts.withColumn("salt", salt).repartition("slice", "salt").sortWithinPartitions("slice", "salt").select("slice", "payload").mapInArrow(_add_up, "slice int, payload binary")
    sums = np.zeros(1 << bits, np.uint32)
    width = (1 << bits) // SLICES
    for r in parts.collect():  # SLICES rows of fixed size for each salt left
        sums[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["payload"])), np.uint32)
    mean = float(sums.mean())
    return np.floor(8 * np.log2(1.0 + sums)).astype(np.uint8), int(8 * np.log2(1 + max(1.0, mean - 3 * mean**0.5)))


def _least_size(classes: int, num: int, den: int) -> int:
    """Sets of over so many tokens can be indexed with this many classes."""
    return -(-(classes + 1) * den // num) if classes else 0


def signatures(tokens: np.ndarray, level: np.ndarray, rare: int, num: int, den: int) -> np.ndarray:
    """The index keys of one set: levels up to `rare` alone, others in pairs of a class."""
    n = len(tokens)
    if not n:
        return tokens
    need = n + (-num * n // den) + 1  # n - ceil(t n) + 1
    order = np.lexsort((tokens, level))
    ranked = tokens[order]
    alone = int(np.searchsorted(level[order], rare, "right"))
    out = []
    for i, classes in enumerate(CLASSES):
        low = _least_size(classes, num, den)
        top = _least_size(CLASSES[i + 1], num, den) if i + 1 < len(CLASSES) else None
        if n <= low or (top is not None and n * num > top * den):
            continue
        salt = U(mix(np.array([classes + 1], U))[0])
        if not classes:
            out.append(mix(ranked[:need] ^ salt))
            continue
        out.append(mix(ranked[: min(need, alone)] ^ salt))
        if alone >= need:
            continue
        often = ranked[alone:]
        kind = mix(often ^ salt) % U(classes)
        by = np.argsort(kind, kind="stable")
        again = np.zeros(len(often), bool)
        again[by[1:]] = kind[by[1:]] == kind[by[:-1]]
        take = int(np.searchsorted(np.cumsum(again), need - alone, "left")) + 1
        by = np.lexsort((often[:take], kind[:take]))
        often, kind = often[:take][by], kind[:take][by]
        d = 1
        while d < len(often) and (same := kind[d:] == kind[:-d]).any():
            out.append(mix(often[:-d][same] * U(0xD1342543DE82EF95) + mix(often[d:][same] ^ salt)))
            d += 1
    return np.concatenate(out)


def _index(k: int, bits: int, shared, rare: int, num: int, den: int, buckets: int):
    names = ["bucket", "kind", "sig", "node", "n"]

    def short(sig: np.ndarray) -> bytes:  # 48 bits: keys that agree by chance cost a comparison, no more
        return sig.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()

    def rows(bucket: np.ndarray, kind: int, sig, node, n):
        by = np.argsort(bucket, kind="stable")
        bucket, sig, node, n = bucket[by], sig[by], node[by], n[by]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        return [(int(bucket[a]), kind, short(sig[a:z]), node[a:z].tobytes(), n[a:z].tobytes()) for a, z in zip(edges[:-1], edges[1:], strict=True)]

    def run(batches):
        level = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            sets = {node: tokens for node, tokens in shingle_sets(b.column("text").to_pylist(), k) if len(tokens)}
            if not sets:
                continue
            keys = [signatures(t, level[(t & U((1 << bits) - 1)).astype(np.int64)], rare, num, den) for t in sets.values()]
            sizes = [len(x) for x in keys]
            sig = np.concatenate(keys)
            node = np.repeat(np.array(list(sets), np.int64), sizes)
            n = np.repeat(np.array([len(t) for t in sets.values()], np.uint32), sizes)
            # keys that two sets of this batch share are known to be shared; of each, one set alone meets other batches
            by = np.lexsort((node, sig))
            sig, node, n = sig[by], node[by], n[by]
            new = np.concatenate([[True], (sig[1:] != sig[:-1])])
            once = np.concatenate([[True], ~((sig[1:] == sig[:-1]) & (node[1:] == node[:-1]))])
            sig, node, n, new = sig[once], node[once], n[once], new[once]
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate([first, [len(sig)]]))
            local = np.repeat(size > 1, size)
            bucket = (sig % U(buckets)).astype(np.int64)
            out = rows(bucket[first], 0, sig[first], node[first], n[first])
            if local.any():
                out += rows(bucket[local], 1, sig[local], node[local], n[local])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)], names=names)
        forget_words()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The (key, set) rows of keys that two sets share."""
    parts: dict[int, list] = {0: [], 1: []}
    for r in table.to_pylist():
        raw = np.frombuffer(r["sig"], np.uint8).reshape(-1, 6)
        sig = np.zeros((len(raw), 8), np.uint8)
        sig[:, 2:] = raw
        parts[r["kind"]].append([sig.view(U).ravel(), np.frombuffer(r["node"], np.int64), np.frombuffer(r["n"], np.uint32)])
    out = list(parts[1])
    if parts[0]:
        sig, node, n = (np.concatenate(x) for x in zip(*parts[0], strict=True))
        by = np.argsort(sig, kind="stable")
        sig, node, n = sig[by], node[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.concatenate([first, [len(sig)]]))
        many = np.repeat(np.minimum.reduceat(node, first) < np.maximum.reduceat(node, first), size)
        out.append([sig[many], node[many], n[many]])
    sig, node, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.uint32))
    return pa.table({"sig": pa.array(sig.view(np.int64), pa.int64()), "node": pa.array(node, pa.int64()), "n": pa.array(n.astype(np.int64), pa.int64())})


def _per_block(num: int, den: int) -> Column:
    """Sets of a block, of the rows' size class: BLOCK, or fewer where they have more than BLOCK_TOKENS tokens together."""
    largest = F.pow(F.lit(den / num), F.col("class") + 1) if num < den else F.col("class").cast("double")
    return F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.floor(F.lit(float(BLOCK_TOKENS)) / largest)))


def _block_links(num: int, den: int):
    """Of the sets of one or two blocks: a spanning forest of the links between different components."""

    def run(table: pa.Table) -> pa.Table:
        node, c, block = (table.column(x).to_numpy() for x in ("node", "c", "block"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        lists = table.column("tokens")
        size = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists.chunks]).astype(np.int64)
        flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists.chunks])
        by = np.argsort(flat, kind="stable")
        again = flat[by[1:]] == flat[by[:-1]]
        often = np.concatenate([again, [False]]) | np.concatenate([[False], again])  # the others are in no intersection
        column = np.cumsum(~np.concatenate([[False], again])[often]) - 1
        row = np.repeat(np.arange(len(node), dtype=np.int32), size)[by[often]]
        del flat, by, again, often
        shared = np.zeros((len(node), len(node)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            i, z = np.searchsorted(column, [start, start + 4096])
            part = np.zeros((len(node), 4096), np.float32)
            part[row[i:z], column[i:z] - start] = 1
            shared += part @ part.T
        both = shared.astype(np.int64)
        hit = den * both >= num * (size[:, None] + size[None, :] - both)
        hit &= (c[:, None] != c[None, :]) & (block[:, None] == lo) & (block[None, :] == hi)
        x, y = np.nonzero(hit)
        a, b = forest(node[x], node[y]) if len(x) else (node[:0], node[:0])
        let_go()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, sketch_bits: int | None = None, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Words are runs of other than ASCII white space, A-Z lower-cased. A document's set holds its distinct k-word shingles;
    with fewer words, the whole sequence as one; without words it is empty and links with nothing. Two documents
    link when den * |intersection| >= num * |union|. component_id: the smallest doc_id reachable by links, itself
    included. Every link is found or lies inside a component found without it.

    Null text: empty set. Null doc_id: counts as the smallest id and comes back as null. Repeated rows: one row each, in
    one component. Extra columns are ignored. An empty table gives no rows.

    Words, shingles and word sequences are represented by 64-bit hashes throughout: sets are compared as sets of hashes. At n
    distinct shingles in two sets a chance agreement has probability n**2 / 2**64; two different word sequences that agree in
    their hash, at m sequences m**2 / 2**65 for any, count as copies.

    Equal word sequences are one node throughout, so copies cost one row each. Sets that share a key are first compared with at most
    LEADERS of them. The rows of keys whose others then lie in different components are the open ones. They are gathered by the smallest
    component of their key and by size, as sets that link differ in size by at most den / num; within such a group the
    sets are compared in blocks of about BLOCK, and of BLOCK_TOKENS tokens at most, or of one set. A component of more than a block's sets has blocks of its own, which don't meet each other, so a
    large component costs its size times what is outside it. Groups aren't joined to larger ones, so a chain of keys stays
    a chain of small groups. Only a spanning forest of each block's links is written, never the pairs. Keys with over SPREAD rows are
    spread over several tasks.

    The sketch has 2**sketch_bits cells (a broadcast of as many bytes); if not given, 22 to 25 bits, by the input's size.
    """
    spark = prepare(docs.sparkSession)
    if sketch_bits is None:
        sketch_bits = min(25, max(22, (input_bytes(docs) // 128).bit_length()))
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), "text")
    buckets = min(max(64, -(-input_bytes(docs) // bucket_bytes)), 1 << 30)
    counted = written(text.mapInArrow(_count(k, sketch_bits), "doc_id long, node long, n long, slice int, payload binary"), "counted")
    level, rare = levels(counted, sketch_bits)
    sketch = spark.sparkContext.broadcast(level.tobytes())  # 2**sketch_bits bytes
    dealt = text.select("text").mapInArrow(_index(k, sketch_bits, sketch, rare, num, den, buckets), "bucket int, kind int, sig binary, node binary, n binary")
    keys = written(dealt.groupBy("bucket").applyInArrow(_shared, "sig long, node long, n long"), "keys")

    nodes = counted.where("slice is null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    wanted = nodes.join(keys.select("node").distinct(), "node").select(F.col("doc_id").alias("__d"), F.col("node").alias("__node"))

    def build(batches):
        for b in batches:
            rows = [(node, t) for (node, t), want in zip(shingle_sets(b.column("text").to_pylist(), k), b.column("__node").to_pylist(), strict=True) if node == want]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["node", "tokens"])
        forget_words()

    sets = written(text.join(wanted, F.col("doc_id") == F.col("__d")).select("text", "__node").mapInArrow(build, "node long, tokens array<long>"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
        b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        return pairs.join(a, "a").join(b, "b").where(den * both >= num * (F.size("ta") + F.size("tb") - both)).select("a", "b")

    near = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    hot = keys.groupBy("sig").agg(F.count("*").alias("rows")).where(F.col("rows") > SPREAD)
    hot = written(hot.select("sig", F.ceil(F.col("rows") / SPREAD).cast("int").alias("spread")), "hot")
    spread = F.coalesce("spread", F.lit(1))
    salted = keys.withColumn("salt", F.pmod("node", F.lit(LEADERS))).join(hot, "sig", "left").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), spread).cast("int")).drop("spread")
    everywhere = lambda df: df.join(hot, "sig", "left").withColumn("part", F.explode(F.sequence(F.lit(0), spread - 1))).drop("spread")
    leaders = written(salted.groupBy("sig", "salt").agg(F.min(F.struct("node", "n")).alias("low")).select("sig", "salt", F.col("low.node").alias("a"), F.col("low.n").alias("na")), "leaders")
    first = salted.select("sig", "part", F.col("node").alias("b"), F.col("n").alias("nb")).join(everywhere(leaders.drop("salt")), ["sig", "part"]).where("a <> b").where(near)
    edges = written(links(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "links")
    part = components(edges, "a", "b").withColumnsRenamed({"component": "c"})

    # pairs of a key that no leader is part of, and that are not in one component yet
    rest = salted.join(leaders, ["sig", "salt"]).where("node <> a").select("sig", "part", "node", "n").join(part, "node", "left").select("sig", "part", "node", "n", F.coalesce("c", "node").alias("c"))
    rest = written(rest, "rest")
    open_ = written(rest.groupBy("sig").agg(F.min("c").alias("hub"), F.max("c").alias("hi")).where("hub < hi").select("sig", "hub"), "open")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int") if num < den else F.col("n").cast("int")
    near_by = rest.join(everywhere(open_), ["sig", "part"]).select("node", "hub", "c", size_class.alias("own")).distinct()
    groups = written(near_by.select("node", "c", "own", "hub", F.explode(F.array("own", F.col("own") + 1)).alias("class")), "groups")
    by_part = groups.groupBy("hub", "class", "c").agg(F.count("*").alias("m"), F.max("own").alias("top")).withColumn("big", F.col("m") >= _per_block(num, den))
    label = lambda c, i: F.concat_ws("/", c.cast("string"), i.cast("string"))
    blocks_of = lambda m: F.ceil(m / _per_block(num, den)).cast("int")
    numbered = lambda n, c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(c.alias("c"), label(c, i).alias("name")))
    own_blocks = F.flatten(F.collect_list(F.when(F.col("big"), numbered(blocks_of(F.col("m")), F.col("c")))))
    whole = by_part.groupBy("hub", "class").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("top").alias("top"), blocks_of(F.sum(F.when(F.col("big"), 0).otherwise(F.col("m")))).alias("mixed"), own_blocks.alias("bigs"))
    whole = whole.where("lo < hi and top = class").drop("lo", "hi", "top")  # sets below a class alone meet in their own
    small = F.when(F.col("mixed") > 0, numbered(F.greatest("mixed", F.lit(1)), F.lit(None).cast("long"))).otherwise(F.array())
    whole = whole.select("hub", "class", "mixed", F.concat("bigs", small).alias("all"))
    own = groups.join(by_part.drop("top"), ["hub", "class", "c"]).join(whole, ["hub", "class"])
    part_of = F.when(F.col("big"), F.col("c"))
    block = label(part_of, F.pmod(F.xxhash64("node"), F.when(F.col("big"), blocks_of(F.col("m"))).otherwise(F.col("mixed"))))
    own = own.withColumns({"block": block, "others": F.transform(F.filter("all", lambda o: ~F.coalesce(o["c"] == part_of, F.lit(False))), lambda o: o["name"])})
    sent = own.withColumn("other", F.explode("others")).select("hub", "class", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "c")
    more = written(sent.join(sets, "node").groupBy("hub", "class", "lo", "hi").applyInArrow(_block_links(num, den), "a long, b long"), "links")
    if more.limit(1).count():
        part = components(edges.union(more), "a", "b").withColumnsRenamed({"component": "c"})

    whole = written(nodes.join(part, "node", "left").withColumn("c", F.coalesce("c", "node")).select("node", "doc_id", "c"), "nodes")
    smallest = whole.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = whole.join(smallest, "c").select("node", "component_id")
    out = counted.where("slice is null").select("doc_id", "node", "n").join(named, "node")
    back = {c: F.when(F.col(c) != LOWEST, F.col(c)) for c in ("doc_id", "component_id")}
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).select(back["doc_id"].alias("doc_id"), F.col("n").alias("n_shingles"), back["component_id"].alias("component_id"))
