"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells. Every distinct vector is stored in the cell of its
nearest centroids. It looks for partners in cells in the multi-sequence order, likeliest first: how likely a partner at the
threshold lies in a cell follows from the distances to the bisectors between centroids, for each half apart. The traversal
stops when the cells visited hold a partner with the target recall. What shares a cell is verified. Of two vectors the one with
the larger cell number looks for the other, so a pair is met once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import components, prepare, written


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows, none of them zero, at length 1 in double precision; scaled first, so that no square overflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids: distinct rows picked at random, each the likelier the farther it lies from those before; then Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    c = x[rng.integers(len(x))][None, :]
    far = ((x - c[0]) ** 2).sum(1)
    while len(c) < k and far.max() > 1e-12:
        c = np.concatenate([c, x[rng.choice(len(x), p=far / far.sum())][None, :]])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def fit(vectors: DataFrame, codebook: int, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks for both halves, by dimension, from at most `sample` vectors (those of smallest hash)."""
    some = vectors.select("embedding").orderBy(F.xxhash64("embedding", F.lit(1)), "embedding").limit(sample).toPandas()["embedding"].tolist()
    out = {}
    for dim in sorted({len(v) for v in some}):
        x = unit(np.array([v for v in some if len(v) == dim]))
        half = max(1, dim // 2)
        out[dim] = kmeans(x[:, :half], codebook), kmeans(x[:, half:], codebook) if dim > half else np.zeros((1, 0))
    return out


def margins(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, distance of each row to the bisector between it and every centroid, 0 for itself)."""
    if x.shape[1] == 0:
        return np.zeros(len(x), np.int64), np.zeros((len(x), len(c)))
    d = ((x * x).sum(1)[:, None] + (c * c).sum(1)) - 2 * x @ c.T
    near = np.argmin(d, axis=1)
    gap = np.sqrt(np.maximum(((c[:, None, :] - c[None]) ** 2).sum(2), 0))[near]
    return near, np.maximum(np.where(gap > 0, (d - d[np.arange(len(x)), near][:, None]) / (2 * np.where(gap > 0, gap, 1)), 0), 0)


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution for z >= 0, to about 1e-7 (a rational approximation)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def shares(near: np.ndarray, margin: np.ndarray, spread: float) -> np.ndarray:
    """How likely a partner's half lies nearest to each centroid, if its displacement towards a bisector has this deviation."""
    p = _tail(margin / spread)
    rows = np.arange(len(near))
    p[rows, near] = 0
    p[rows, near] = np.maximum(1 - p.sum(1), 0.5)
    return p / p.sum(1, keepdims=True)


def in_order(u: list[float], v: list[float]):
    """Index pairs (i, j) by falling u[i] * v[j], for falling u and v: the multi-sequence traversal, a heap of open ends."""
    heap = [(-u[0] * v[0], 0, 0)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        yield -cost, i, j
        if j + 1 < len(v):
            heapq.heappush(heap, (-u[i] * v[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (-u[i + 1] * v[0], i + 1, 0))


def visited(p1: np.ndarray, p2: np.ndarray, target: float) -> list[list[tuple[int, int]]]:
    """Of each row, the cells (i, j) in the order of p1[i] * p2[j] until their sum reaches the target."""
    o1, o2 = np.argsort(-p1, axis=1, kind="stable"), np.argsort(-p2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(p1, o1, 1).tolist(), np.take_along_axis(p2, o2, 1).tolist()
    out = []
    for a, b, u, v in zip(o1.tolist(), o2.tolist(), s1, s2, strict=True):
        cells, total = [], 0.0
        for p, i, j in in_order(u, v):
            cells.append((a[i], b[j]))
            total += p
            if total >= target:
                break
        out.append(cells)
    return out


def visited_whole(m1: np.ndarray, m2: np.ndarray, length: float) -> list[list[tuple[int, int]]]:
    """Of each row, all cells that a displacement of at most `length` can reach, in the same order by distance."""
    out = []
    for a, b in zip(m1, m2, strict=True):
        o1, o2 = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        cells = []
        for p, i, j in in_order(np.exp(-(a[o1] ** 2)).tolist(), np.exp(-(b[o2] ** 2)).tolist()):
            if p < math.exp(-(length**2)) * (1 - 1e-9):
                break
            cells.append((int(o1[i]), int(o2[j])))
        out.append(cells)
    return out


def _place(books: dict, cosine: float, target: float):
    """Rows with row and col (the home cell) and asks: [(grid row, [columns])], the cells before the home that are visited."""

    def run(batches):
        for b in batches:
            vectors = b.column("embedding")
            dims = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            begin = vectors.offsets.to_numpy() - vectors.offsets.to_numpy()[0]
            row, col, asks = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = unit(flat[(begin[own][:, None] + np.arange(dim))])
                half = max(1, dim // 2)
                c1, c2 = books.get(dim) or (np.zeros((1, half)), np.zeros((1, dim - half)))
                (n1, m1), (n2, m2) = margins(x[:, :half], c1), margins(x[:, half:], c2)
                length = math.sqrt(max(0.0, 2 - 2 * cosine))
                if target >= 1 or dim < 16 or not length:
                    cells = visited_whole(m1, m2, length)
                else:
                    spread = length / math.sqrt(dim)
                    cells = visited(shares(n1, m1, spread), shares(n2, m2, spread), target)
                row[own], col[own] = n1, n2
                for k, found in zip(own.tolist(), cells, strict=True):
                    home, by_row = (int(row[k]), int(col[k])), {int(row[k]): []}
                    for i, j in found:
                        if (i, j) < home:
                            by_row.setdefault(i, []).append(j)
                    asks[k] = [{"row": i, "cols": js} for i, js in by_row.items()]
            kind = pa.list_(pa.struct([("row", pa.int32()), ("cols", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(asks, kind)], names=[*b.schema.names, "dim", "row", "col", "asks"])

    return run


def _linked(hit: np.ndarray, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of the connected part of each row (ids q) and column (ids t) of a hit matrix."""
    none = np.iinfo(np.int64).max
    x, y = q.copy(), t.copy()
    while True:
        nx = np.minimum(x, np.where(hit, y[None, :], none).min(1))
        ny = np.minimum(y, np.where(hit, nx[:, None], none).min(0))
        if np.array_equal(nx, x) and np.array_equal(ny, y):
            return x, y
        x, y = nx, ny


def _verify(cosine: float):
    """Of the vectors of one block: links counted by vector, with the copies on the other side, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        t, a = (table.column(c)[0].as_py() for c in ("t", "a"))
        ids, n, col, home, tc, ac = (table.column(c).to_numpy() for c in ("id", "n", "col", "home", "tc", "ac"))
        vectors = table.column("embedding").combine_chunks()
        x = unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        cols = table.column("cols").to_pylist()
        target, asker = home & (tc == t), ac == a
        wanted: dict[int, list[int]] = {}
        for k in np.flatnonzero(asker).tolist():
            for j in ([*cols[k], int(col[k])] if home[k] else cols[k]):
                wanted.setdefault(j, []).append(k)
        out = []
        for j in np.unique(col[target]).tolist():
            ts = np.flatnonzero(target & (col == j))
            for at in range(0, len(wanted.get(j, [])), 512):
                qs = np.array(wanted[j][at : at + 512])
                hit = x[qs] @ x[ts].T >= cosine
                inside = home[qs] & (col[qs] == j)
                hit &= ~inside[:, None] | (ids[qs][:, None] > ids[ts][None, :])  # of a cell's own pairs each is met once
                if not hit.any():
                    continue
                qk, tk = hit.any(1), hit.any(0)
                sub = hit[qk][:, tk]
                q, s = qs[qk], ts[tk]
                r1, r2 = _linked(sub, ids[q], ids[s])
                out.append((ids[q], sub @ n[s], r1))
                out.append((ids[s], n[q] @ sub, r2))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("id", "n", "root"), columns, strict=True)})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, codebook: int | None = None, target_recall: float = 0.999, sample: int = 20_000, block: int = 4096, cell: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Rows with equal, non-null labels (and as many dimensions) link when the cosine, in double precision, is at least
    `cosine`. n_links counts the other vectors linked directly; component_id is the smallest vec_id reachable;
    kept is vec_id = component_id. Null, empty or zero vectors, those with null, NaN or infinite parts and those with a null
    label link with nothing: their component is their own id. Null vec_id: no links, null component, kept false.
    Rows that repeat a vec_id are one vector for links (the one of smallest hash) and each come back. Extra columns are ignored.
    An empty table gives no rows.

    Equal vectors of a label are one entry with a count. The codebooks are fitted on at most `sample` vectors; every vector is
    indexed. `codebook` is the number of centroids of a half; if it is not given, as many as make cells of about `cell` vectors
    in the largest label, at most 64. The traversal is approximate unless target_recall is 1, which visits all that a partner
    can reach; what it finds is exact. A vector is sent once to each row of the grid that it visits. Where a row holds, or is
    visited by, more than `block` vectors, both sides are cut into blocks and each pair of blocks is a task of its own;
    pairs are never written out, only counts and a spanning forest of each block.
    """
    spark = prepare(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType
    part = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{part}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    able = rows.where(fine)
    if able.groupBy("vec_id").count().where("count > 1").limit(1).count():
        able = able.groupBy("vec_id").agg(F.min_by(F.struct("embedding", "label"), F.xxhash64("embedding", "label")).alias("v")).select("vec_id", "v.*")
    classes = written(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    if codebook is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        codebook = int(min(64, max(4, math.ceil(math.sqrt(largest / cell)))))
    schema = f"id long, n long, label string, embedding array<{part}>, dim int, row int, col int, asks array<struct<row:int,cols:array<int>>>"
    placed = written(classes.select("id", "n", "label", "embedding").mapInArrow(_place(fit(classes, codebook, sample), cosine, target_recall), schema), "placed")

    key = ["label", "dim", "row"]
    sent = placed.select("id", "n", "label", "dim", "col", "embedding", F.col("row").alias("own"), F.explode("asks").alias("ask"))
    sent = sent.select("id", "n", "label", "dim", "col", "embedding", F.col("ask.row").alias("row"), F.col("ask.cols").alias("cols"), (F.col("own") == F.col("ask.row")).alias("home"))
    blocks = lambda what: F.ceil(what / block).cast("int")
    sizes = sent.groupBy(*key).agg(F.greatest(blocks(F.count_if("home")), F.lit(1)).alias("ts"), blocks(F.count("*")).alias("as"))
    cut = sent.join(sizes, key).withColumns({"tc": F.pmod(F.xxhash64("id"), F.col("ts")).cast("int"), "ac": F.pmod(F.xxhash64("id", F.lit(1)), F.col("as")).cast("int")})
    as_target = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("as") - 1), lambda a: F.struct(F.col("tc").alias("t"), a.alias("a")))).otherwise(F.array())
    as_asker = F.transform(F.sequence(F.lit(0), F.col("ts") - 1), lambda t: F.struct(t.alias("t"), F.col("ac").alias("a")))
    tasks = cut.select("id", "n", *key, "col", "embedding", "cols", "home", "tc", "ac", F.explode(F.array_union(as_target, as_asker)).alias("p")).select("*", "p.t", "p.a").drop("p")
    found = written(tasks.groupBy(*key, "t", "a").applyInArrow(_verify(cosine), "id long, n long, root long"), "found")

    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    tree = components(found.where("id <> root").select("id", "root").distinct(), "id", "root").withColumnsRenamed({"node": "id", "component": "low"})
    # what differs from "no link" by class, and by row the class of rows that have copies
    result = classes.select("id", "n").join(counts, "id", "left").join(tree, "id", "left").where("n > 1 or links > 0")
    result = written(result.select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("low", "id").alias("low")), "result")
    name = [F.xxhash64("label", "embedding"), F.xxhash64("embedding", "label", F.lit(1))]
    copies = classes.where("n > 1").select(name[0].alias("h1"), name[1].alias("h2"), F.col("id").alias("__class"))
    hashes = [F.when(fine, name[0]).otherwise(F.xxhash64("vec_id")).alias("h1"), F.when(fine, name[1]).otherwise(F.lit(0)).alias("h2")]
    out = rows.select("vec_id", fine.alias("fine"), *hashes).join(copies, ["h1", "h2"], "left")
    out = out.withColumn("id", F.when(F.col("fine"), F.coalesce("__class", "vec_id")).otherwise(F.monotonically_increasing_id() * -1 - 2**62))
    out = out.join(result.withColumn("has", F.lit(True)), "id", "left").withColumn("has", F.coalesce("has", F.lit(False)) & F.col("fine"))
    root = F.when(F.col("has"), F.col("low")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("has"), F.col("links")).otherwise(F.lit(0)).alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))
