"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A stretch of a document within k edits of a window of w characters of a benchmark item shares at least w + 1 - q (k + 1) of the
window's q-grams, all of them within k diagonals. Shared q-grams are counted in bands of 2k diagonals that begin every k
diagonals, so some band holds all of a stretch's; every window that reaches the bound in a band is verified by banded alignment.

The bound is above 0 only if q <= w / (k + 1). Items too short for that at the given q are indexed by shorter q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let_go, mix, prepare

U = np.uint64
BITS = 22


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, U)
    out, wide = np.zeros(n, U), codes.astype(U)
    for j in range(q):
        out *= U(0x9E3779B97F4A7C15)
        out += wide[j : n + j]
    return mix(out)


def edits_within(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of a stretch of text nearest to the whole pattern, if within k edits, else None.

    The stretch may begin and end anywhere; text is the band's region, so at most a few k longer than the pattern, and all of
    its diagonals are computed, a row of the pattern at a time.
    """
    n = len(text)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, c in enumerate(pattern):
        change, drop = row[:-1] + (text != c), row[1:] + 1
        new, come = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], come[0] = i + 1, 0
        better = change <= drop
        new[1:], come[1:] = np.where(better, change, drop), np.where(better, origin[:-1], origin[1:])
        slid = np.minimum.accumulate(new - steps)  # insertions run along the row
        moved = slid + steps < new
        if moved.any():
            held = np.maximum.accumulate(np.where(moved, 0, steps))
            new, come = slid + steps, come[held]
        row, origin = new, come
        if row.min() > k:
            return None
    end = int(np.argmin(row))
    return (int(row[end]), int(origin[end]), end) if row[end] <= k else None


@dataclass
class Items:
    """The q-grams of some benchmark items: sorted hashes with, for each, where it stands. No window of theirs needs fewer than
    `need` shared q-grams."""

    q: int
    need: int
    ids: list[int]
    codes: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    size: np.ndarray
    item: np.ndarray
    at: np.ndarray
    filter: np.ndarray
    whole_words: bool


def bounds(n: int, q: int, window: int, rate: float) -> tuple[int, int, int]:
    """(w, k, need): window, edits and shared q-grams for an item of n characters. The last doesn't grow with n."""
    w = min(window, n)
    k = int(rate * w)
    return w, k, max(1, w + 1 - q * (k + 1))


def index_items(rows: list[tuple[int, str | None]], q: int, least: int, window: int, rate: float, whole_words: bool = True) -> list[Items]:
    """An index for each length of q-grams: q, or for a short item the longest that leaves its bound above 0."""
    by_q = {}
    for i, t in rows:
        c = _codes(normal(t).replace("\0", " "))
        if len(c) >= max(1, least):
            w, k, _ = bounds(len(c), q, window, rate)
            by_q.setdefault(max(1, min(q, w // (k + 1))), []).append((i, c))
    return [_index(kept, own, window, rate, whole_words) for own, kept in sorted(by_q.items())]


def _index(kept: list[tuple[int, np.ndarray]], q: int, window: int, rate: float, whole_words: bool) -> Items:
    hashes = [gram_hashes(c, q) for _, c in kept]
    h = np.concatenate([*hashes, np.empty(0, U)])
    item = np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for x in hashes])
    at = np.concatenate([*(np.arange(len(x), dtype=np.int32) for x in hashes), np.empty(0, np.int32)])
    by = np.argsort(h, kind="stable")
    keys, first, size = np.unique(h[by], return_index=True, return_counts=True)
    bits = np.zeros(1 << BITS, bool)
    bits[(keys >> U(64 - BITS)).astype(np.int64)] = True
    need = min((bounds(len(c), q, window, rate)[2] for _, c in kept), default=1)
    return Items(q, need, [i for i, _ in kept], [c for _, c in kept], keys, first.astype(np.int32), size.astype(np.int32), item[by], at[by], bits, whole_words)


def gram_hits(codes: np.ndarray, items: Items, window: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, indexes into items.keys) of the q-grams of codes that items hold, in stretches with enough of them.

    A matching stretch of any item has items.need such q-grams within window + k characters, whatever their diagonals; others are left out.
    """
    if not len(items.keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(codes, items.q)
    hits = np.flatnonzero(items.filter[(h >> U(64 - BITS)).astype(np.int64)])
    i = np.searchsorted(items.keys, h[hits])
    i[i == len(items.keys)] = 0
    real = items.keys[i] == h[hits]
    hits, i = hits[real], i[real]
    need = items.need
    if len(hits) < need:
        return hits[:0], i[:0]
    dense = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] <= window + int(rate * window))
    change = np.bincount(dense, minlength=len(hits) + 1) - np.bincount(dense + need, minlength=len(hits) + 1)[: len(hits) + 1]
    keep = np.cumsum(change)[:-1] > 0
    return hits[keep], i[keep]


def _verbatim(pattern: np.ndarray, codes: np.ndarray, diagonal: int, w: int, lo: int, hi: int) -> np.ndarray:
    """The starts from lo to hi of windows of the pattern that codes hold unchanged on a diagonal."""
    a, z = max(lo, -diagonal), min(hi + w, len(pattern), len(codes) - diagonal)
    if z - a < w:
        return np.empty(0, np.int64)
    same = np.concatenate([[0], np.cumsum(pattern[a:z] == codes[a + diagonal : z + diagonal])])
    return a + np.flatnonzero(same[w:] - same[:-w] == w)


def _inside_word(a: int, b: int) -> bool:
    """Whether a word goes on from character a to b; scripts without spaces (from U+2E80) have no such words."""
    return max(a, b) < 0x2E80 and chr(a).isalnum() and chr(b).isalnum()


def _whole_words(codes: np.ndarray, begin: np.ndarray, w: int) -> np.ndarray:
    """Which stretches of w characters cut no word."""
    return np.array([not (b > 0 and _inside_word(codes[b - 1], codes[b])) and not (b + w < len(codes) and _inside_word(codes[b + w - 1], codes[b + w])) for b in begin.tolist()], bool)


def align_windows(pattern: np.ndarray, codes: np.ndarray, starts: np.ndarray, w: int, k: int, low: int, width: int) -> tuple[np.ndarray, ...]:
    """(window's start, edits, start and end in codes) of the nearest stretch to each window of the pattern that has one within k.

    Stretches that touch one of the `width` diagonals from `low` on are seen. All windows advance together, a character at a
    time, over those diagonals and k on either side; those beyond k edits are given up.
    """
    wide = width + 2 * k
    unit = 1 << wide.bit_length()  # a cell is edits * unit + the diagonal where its stretch begins
    steps = (np.arange(wide) * unit)[:, None]
    place = starts + low - k + np.arange(w + wide)[:, None]
    inside = (place >= 0) & (place < len(codes))
    text = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
    wanted = pattern[starts + np.arange(w)[:, None]]
    row = np.repeat(np.arange(wide)[:, None], len(starts), axis=1)
    for i in range(w):
        new = row + unit * (text[i : i + wide] != wanted[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + unit)
        row = np.minimum.accumulate(new - steps, axis=0) + steps
        if i % 8 == 7 or i == w - 1:
            alive = row.min(axis=0) < (k + 1) * unit
            if not alive.all():
                row, text, wanted, starts = row[:, alive], text[:, alive], wanted[:, alive], starts[alive]
                if not len(starts):
                    break
    end = row.argmin(axis=0)
    best = row[end, np.arange(len(starts))]
    begin = starts + low - k + best % unit
    return starts, best // unit, np.maximum(begin, 0), np.minimum(starts + w + low - k + end, len(codes))


def find_in(codes: np.ndarray, items: Items, window: int, rate: float, hits: np.ndarray, i: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(item, document start, end, item start, end, edits) over all verified stretches of each item, in characters of the
    normalised texts. Every window of the item that shares enough q-grams with a band is verified."""
    if not len(hits):
        return []
    n = items.size[i]
    which = np.repeat(items.first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, item, at = np.repeat(hits, n), items.item[which].astype(np.int64), items.at[which].astype(np.int64)
    spans = {}

    def add(it, starts, w, begin, end, edits):
        if len(starts):
            new = (int(begin.min()), int(end.max()), int(starts.min()), int(starts.max()) + w, int(edits.max()))
            old = spans.get(it, new)
            spans[it] = tuple(f(x, y) for f, x, y in zip((min, max, min, max, max), old, new, strict=True))

    step = max(1, int(rate * window))
    band = item * (1 << 44) + (place - at + (1 << 40)) // step
    key = np.concatenate([band, band - 1])  # a hit counts in the band that begins at its diagonal's step and in the one before
    by = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1], [True]]))
    for g in np.flatnonzero(np.diff(edges) >= items.need).tolist():
        x = by[edges[g] : edges[g + 1]]
        low = (int(key[x[0]]) % (1 << 44)) * step - (1 << 40)
        x %= len(place)
        it = int(item[x[0]])
        pattern = items.codes[it]
        w, k, need = bounds(len(pattern), items.q, window, rate)
        shared = np.unique(at[x])
        if len(shared) < need:
            continue
        starts = np.arange(max(0, int(shared[0]) - w + items.q), min(len(pattern) - w, int(shared[-1])) + 1)
        starts = starts[np.searchsorted(shared, starts + w - items.q, "right") - np.searchsorted(shared, starts) >= need]
        if not len(starts):
            continue
        diagonals, grams = np.unique(place[x] - at[x], return_counts=True)
        for d in diagonals[grams > w - items.q].tolist():
            same = _verbatim(pattern, codes, d, w, int(starts[0]), int(starts[-1]))
            if not k and items.whole_words:
                same = same[_whole_words(codes, same + d, w)]
            add(it, same, w, same + d, same + d + w, np.zeros(1, np.int64))
            starts = np.setdiff1d(starts, same, assume_unique=True)
            if not len(starts):
                break
        if not k:
            continue
        for a in range(0, len(starts), 1024):
            found, edits, begin, end = align_windows(pattern, codes, starts[a : a + 1024], w, k, low, 2 * step)
            add(it, found, w, begin, end, edits)
    return sorted((items.ids[it], *span) for it, span in spans.items())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 80, rate: float = 0.075, q: int = 10, block_chars: int = 4 << 20, least: int = 10, whole_words: bool = True) -> DataFrame:
    """doc_id, item_id, doc_start, doc_end, item_start, item_end, edits: one row for each (doc_id, item_id) with a match.

    Texts are compared in lower case with runs of white space as one space; positions count characters of that form. A match
    is a stretch of the document within rate * w edits of w consecutive characters of the item, w the smaller of `window`
    and the item's length. Where that leaves no edit (items of fewer than 14 characters by the defaults), a match also cuts no
    word, unless whole_words is False. The row spans the verified stretches; edits is the largest of theirs.

    Null or empty texts match nothing, nor do items of fewer than `least` characters: such words stand in clean texts, too.
    least=1 with whole_words=False is exact for items of any length. Null doc_id or item_id are reported as they are;
    repeated rows each count, so their matches merge into one row. Extra columns are ignored. No documents or no items: no
    rows.

    The index of about block_chars characters of items (or of one larger item) is built once, on the driver, and goes to the workers as
    arrays of 28 bytes a character; a larger benchmark takes several passes over the documents. The texts are not shuffled; only matches are.
    """
    out = None
    for index in _blocks(docs, benchmark, block_chars, q, least, window, rate, whole_words):
        found = _search(docs, index, window, rate)
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(*(f(c).alias(c) for f, c in ((F.min, "doc_start"), (F.max, "doc_end"), (F.min, "item_start"), (F.max, "item_end"), (F.max, "edits"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 80, rate: float = 0.075, q: int = 10, block_chars: int = 4 << 20, least: int = 10, whole_words: bool = True) -> DataFrame:
    """The rows of docs, all columns, whose text matches no item in the sense of find_contamination.

    Each row is judged by its own text, whether doc_id is null, repeated or missing. Nothing is shuffled or joined.
    """
    for index in _blocks(docs, benchmark, block_chars, q, least, window, rate, whole_words):
        docs = _without(docs, index, window, rate)
    return docs


def _blocks(docs: DataFrame, benchmark: DataFrame, block_chars: int, q: int, least: int, window: int, rate: float, whole_words: bool):
    """Broadcast indexes of the benchmark's items, each of bounded size."""
    spark = prepare(docs.sparkSession)
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        some = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in some.select("item_id", "text").collect()]
        yield spark.sparkContext.broadcast(index_items(rows, q, least, window, rate, whole_words))


def _matches(texts: list[str | None], index: list[Items], window: int, rate: float) -> list[tuple[int, int, int, int, int, int, int]]:
    """(number of the text, item, document start, end, item start, end, edits)."""
    rows = []
    if not index:
        return rows
    for start in range(0, len(texts), 200):
        some = [normal(t) for t in texts[start : start + 200]]
        codes = _codes(("\0" * max(x.q for x in index)).join(some))  # no item holds such a character
        size = np.array([len(t) for t in some])
        begin = np.concatenate([[0], np.cumsum(size + max(x.q for x in index))])
        for items in index:
            hits, keys = gram_hits(codes, items, window, rate)
            cut = np.searchsorted(hits, begin)
            for d in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[d], cut[d + 1])
                found = find_in(codes[begin[d] : begin[d] + size[d]], items, window, rate, hits[own] - begin[d], keys[own])
                rows += [(start + d, *m) for m in found]
    return rows


def _search(docs: DataFrame, shared, window: int, rate: float) -> DataFrame:
    def run(batches):
        index = shared.value
        for b in batches:
            rows = _matches(b.column("text").to_pylist(), index, window, rate)
            doc = b.column("doc_id").to_pylist()
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            columns[0] = [doc[i] for i in columns[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.int32()], strict=True)], names=["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "edits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, edits int")


def _without(docs: DataFrame, shared, window: int, rate: float) -> DataFrame:
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for texts in batches:
            found = {m[0] for m in _matches(texts.tolist(), index, window, rate)}
            yield pd.Series([i not in found for i in range(len(texts))], dtype=bool)
        let_go()

    return docs.where(clean("text"))
