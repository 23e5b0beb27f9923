"""Best-fit packing by linear grouping: few rounded sizes, optimised configurations, real documents, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import prepare, written
from tessera.llm.encoding import encoder, gathered


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and part (the task that made the row) of every text's ids and end id.

    Texts of over `capacity` ids are cut into pieces of `capacity`; the first piece takes the remainder.
    """

    def cut(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        for b in gathered(batches):
            ids, edges = enc.encode(b.column("text").combine_chunks(), end_id)
            n = np.diff(edges)
            many = -(-n // capacity)  # pieces of each document, the first of them (n - 1) % capacity + 1 ids long
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = ((n - 1) % capacity + 1)[row]
            start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first)
            raw, at = memoryview(ids.astype("<u4")).cast("B"), 4 * (edges[row] + start)
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [b.column("doc_id").combine_chunks().take(pa.array(row)), *(pa.array(c, k) for c, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (np.full(len(row), part), pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int")


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for j in np.argsort(-values / sizes):
        if values[j] <= 1e-12:
            break
        w, v = int(sizes[j]), values[j]
        for _ in range(capacity // w):
            other = best[:-w] + v if w else best
            better = other > best[w:] + 1e-12
            if not better.any():
                break
            best[w:][better] = other[better]
            took[w:][better] = j
    pattern, c = np.zeros(len(sizes)), int(np.argmax(best))
    while c > 0 and took[c] >= 0:
        pattern[took[c]] += 1
        c -= int(sizes[took[c]])
    return float(best.max()), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """[(items of each size, how often)] that packs at most the demand: the LP over all configurations, rounded down.

    Column generation: a basis of as many configurations as there are sizes; the knapsack finds the one to enter.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_pattern(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        used, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(np.argmin(ratio))] = column
    used = np.floor(np.linalg.solve(basis, demand.astype(float)) + 1e-6).astype(int)
    out, left = [], demand.astype(int).copy()
    for j in np.argsort(-used):
        column = np.rint(basis[:, j]).astype(int)
        times = min([max(0, int(used[j])), *(int(left[i] // column[i]) for i in np.flatnonzero(column))])
        if times > 0:
            out.append((column, times))
            left -= column * times
    return out


class Sequences:
    """Sequences in runs of equal contents: free space -> [(lengths of the pieces in it, how many such sequences)]."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.order = capacity, {}, []

    def add(self, pieces: tuple[int, ...], n: int) -> None:
        room = self.capacity - sum(pieces)
        if room not in self.free:
            self.free[room] = []
            insort(self.order, room)
        self.free[room].append((pieces, n))

    def place(self, length: int, n: int) -> None:
        """n pieces of this length: each into the fullest sequence that has room, else a new one."""
        while n:
            i = bisect_left(self.order, length)
            if i < len(self.order):
                room = self.order[i]
                pieces, have = self.free[room].pop()
                m = min(n, have)
                if m < have:
                    self.free[room].append((pieces, have - m))
                elif not self.free[room]:
                    del self.free[room]
                    self.order.pop(i)
                self.add((*pieces, length), m)
            else:
                fit = self.capacity // length
                m = n if fit == 1 else n // fit
                if m:
                    self.add((length,) * fit, m)
                    m *= fit
                else:
                    m = n
                    self.add((length,) * n, 1)
            n -= m

    def all(self) -> list[tuple[tuple[int, ...], int]]:
        return [run for room in self.order for run in self.free[room]]

    def count(self) -> int:
        return sum(n for runs in self.free.values() for _, n in runs)

    def reopened(self, waste: int, others: dict[int, int]) -> Sequences:
        """Those with less free space than `waste`; the pieces of all else and the `others` placed anew, largest first."""
        out, loose = Sequences(self.capacity), Counter(others)
        for room in self.order:
            for pieces, n in self.free[room]:
                if room < waste:
                    out.add(pieces, n)
                    continue
                for length in pieces:
                    loose[length] += n
        for length in sorted(loose, reverse=True):
            out.place(length, loose[length])
        return out


def _grouped(large: list[tuple[int, int]], groups: int) -> tuple[list[int], list[list[list[int]]]]:
    """(size, [length, how many] of each member length) of groups of about equally many pieces; a size is its group's largest."""
    each = -(-sum(c for _, c in large) // groups)
    members: list[list[list[int]]] = []
    room = 0
    for s, c in large:
        while c:
            if not room:
                members.append([])
                room = each
            m = min(c, room)
            members[-1].append([s, m])
            c, room = c - m, room - m
    sizes: list[int] = []
    merged: list[list[list[int]]] = []
    for g in members:  # groups that begin with the same length are one size
        if sizes and sizes[-1] == g[0][0]:
            merged[-1] += g
        else:
            sizes.append(g[0][0])
            merged.append(g)
    return sizes, merged


def _substituted(slots: list[list[list[int]]], times: int):
    """(real lengths, how many) of `times` copies of a configuration, a slot taking its group's pieces from the largest on."""
    while times:
        n = times
        for j in slots:  # as many as the first member of every slot's group lasts
            n = min(n, max(1, j[0][1] // sum(x is j for x in slots)))
        pieces = []
        for j in slots:
            pieces.append(j[0][0])
            j[0][1] -= n
            if not j[0][1]:
                j.pop(0)
        yield tuple(pieces), n
        times -= n


def plan(histogram: dict[int, int], capacity: int = 2048, groups: int = 64, small: float = 1 / 3) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset): where the pieces of each length go, by rank.

    Works on the histogram of lengths, so its cost depends on the capacity, not on how many documents there are. Pieces
    over small * capacity, largest first, are split into `groups` groups of equally many; within a group
    each counts as its largest. Configurations of these few sizes are optimised and filled with the group's real
    pieces. What the rounding left, with all small pieces, goes by best fit, largest first. Where that takes more sequences than
    the ids need, configurations that real pieces fill badly (free space that few small pieces fit into) are opened again and
    their pieces go by best fit too: ever more of them, until no sequence is wasted, or only exactly filled ones are left.
    """
    filled, rest = Sequences(capacity), Counter(histogram)
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if small * capacity < s < capacity]
    if large:
        sizes, merged = _grouped(large, groups)
        demand = np.array([sum(m for _, m in g) for g in merged])
        for column, times in configurations(np.array(sizes), demand, capacity):
            for pieces, n in _substituted([merged[j] for j in np.flatnonzero(column) for _ in range(column[j])], times):
                filled.add(pieces, n)
                rest.subtract({length: n * k for length, k in Counter(pieces).items()})
    rest = +rest
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    packed, waste = filled.reopened(capacity + 1, rest), capacity
    while waste > 1 and packed.count() > least:
        waste //= 2
        packed = min(packed, filled.reopened(waste, rest), key=Sequences.count)
    rows, first, rank = [], 0, dict.fromkeys(histogram, 0)
    for pieces, n in packed.all():
        offset = 0
        for s in pieces:
            rows.append((s, rank[s], n, first, offset))
            rank[s] += n
            offset += s
        first += n
    rows = np.array(rows, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every text's ids packed into few sequences.

    Null or empty text: the end id alone. Null doc_id: packed like any other. Repeated rows: each is packed, with its
    own pieces. Extra columns are ignored. An empty table gives no rows.

    Only the histogram of lengths (at most `capacity` rows) reaches the driver. A piece's rank among those of its length
    is its rank within its task plus the counts of the tasks before; the pieces of a frequent length spread over
    all tasks. The texts are not shuffled.
    """
    prepare(docs.sparkSession)
    made = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = written(made.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, capacity)
    base = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = made.withColumn("r", within - 1).join(base, ["length", "part"]).withColumn("r", F.col("r") + F.col("base"))
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # at most a few runs for each pair of length and free space

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        i = np.searchsorted(p[:, 0] * (1 << 44) + p[:, 1], length.to_numpy() * (1 << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": p[i, 3] + rank.to_numpy() - p[i, 1], "offset": p[i, 4]})

    return ranked.withColumn("p", place("length", "r")).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")
