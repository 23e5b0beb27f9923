"""Substring dedup by recompression: consistent names for runs and pairs reveal repeated windows, their words verify them.

Every round replaces runs of one symbol, or pairs (left symbol, right symbol) by the name of the run or pair. A name is a
hash of what it stands for and a symbol's side is a bit of its hash, so all tasks name alike without asking each other.
With each symbol goes its context: the stretch of words that alone decided it. Equal windows hold the same symbols at
the same places wherever a symbol's context lies inside the window. Each window is dealt out by one such symbol (that of
smallest hash), so equal windows meet; symbols of a single document are dropped unseen, the others' windows are compared.
A window without such a symbol (a long run, for one) is dealt out by its own hash.

What this finds are stretches of windows with, for each, a stretch of an earlier document that should hold the same words. A
stretch goes only if it does: within a batch words are compared, beyond it 128-bit digests of the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWEST, input_bytes, mix, prepare, word_hashes, words_of, written

ODD = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def _runs(sym, cs, ce):
    first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    size = np.diff(np.concatenate([first, [len(sym)]]))
    out = np.where(size > 1, mix(sym[first] + size.astype(U) * ODD), sym[first])
    last = first + size - 1
    return out, cs[np.maximum(first - 1, 0)], ce[np.minimum(last + 1, len(sym) - 1)]


def _pairs(sym, cs, ce, salt):
    left = (mix(sym + mix(np.array([salt], U))) & U(1)) == 0
    joins = np.zeros(len(sym), bool)
    joins[:-1] = left[:-1] & ~left[1:]
    stays = np.ones(len(sym), bool)
    stays[1:] = ~joins[:-1]
    i = np.flatnonzero(stays)
    after, before = np.minimum(i + 1, len(sym) - 1), np.maximum(i - 1, 0)
    named = np.where(joins[i], mix(sym[i] * ODD + mix(sym[after] + U(salt))), sym[i])
    return named, np.where(left[i], cs[i], cs[before]), np.where(left[i], ce[after], ce[i])


def recompress(sym: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, context starts, context ends) after one round of runs and `rounds` rounds of pairs."""
    at = np.arange(len(sym), dtype=np.int64)
    out = _runs(sym, at, at + 1)
    for k in range(rounds):
        out = _pairs(*out, k + 1)
    return out


def _layout(words: list[list[bytes]]):
    """Word hashes of all texts in one array, with a symbol of its own before, between and behind them."""
    table = word_hashes()
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
    sym = np.empty(int(sizes.sum()) + len(words) + 1, U)
    sym[np.concatenate([[0], starts + sizes])] = mix(np.arange(len(words) + 1, dtype=U) * ODD + U(7))
    inside = np.ones(len(sym), bool)
    inside[np.concatenate([[0], starts + sizes])] = False
    sym[inside] = table.of([w for doc in words for w in doc])
    return sym, starts, sizes


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _stretches(doc: np.ndarray, at: np.ndarray, src: np.ndarray, src_at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Merge consecutive windows, given in order, whose sources follow each other too: (which come first, ends)."""
    if not len(doc):
        return np.empty(0, np.int64), at
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (src[1:] != src[:-1]) | (src_at[1:] != src_at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, at[np.concatenate([first[1:], [len(doc)]]) - 1] + window


SPANS = {"d": pa.int64(), "start": pa.int64(), "end": pa.int64(), "src": pa.int64(), "src_start": pa.int64(), "digest": pa.binary()}


def _deal(window: int, rounds: int, buckets: int):
    names = ["bucket", "sym", "doc", "at", "count", "hashes", *SPANS]
    kinds = [pa.int32(), *[pa.binary()] * 5, *SPANS.values()]

    def run(batches):
        for number, b in enumerate(batches):
            ids = np.array([LOWEST if x is None else x for x in b.column("doc_id").to_pylist()], np.int64)
            order = np.argsort(ids, kind="stable")
            texts = b.column("text").to_pylist()
            ids = ids[order]
            words = [words_of(texts[i], False) for i in order]
            sym, starts, sizes = _layout(words)
            n = np.maximum(sizes - window + 1, 0)
            if not n.sum():
                continue
            row = np.repeat(np.arange(len(ids)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            p = starts[row] + at
            whole = np.zeros(len(sym) - window + 1, U)
            c = ODD
            for j in range(window):
                whole += sym[j : len(sym) - window + 1 + j] * c
                c = U((int(c) * 0xD1342543DE82EF95) & (2**64 - 1)) | U(1)
            h = mix(whole[p])
            names_, cs, ce = recompress(sym, rounds)
            lo = np.cumsum(np.bincount(cs, minlength=len(sym) + 1))[p - 1]
            hi = np.cumsum(np.bincount(ce, minlength=len(sym) + 1))[p + window] - 1
            rank = mix(names_)
            best = np.full(len(p), -1, np.int64)
            some = np.flatnonzero(lo <= hi)
            best[some] = lo[some]
            d = 1
            while len(some := some[lo[some] + d <= hi[some]]):
                j = lo[some] + d
                better = rank[j] < rank[best[some]]
                best[some[better]] = j[better]
                d += 1
            # what this batch alone decides: all but the smallest document of equal windows go
            by = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
            lead = np.empty(len(h), np.int64)  # the first of the equal windows, so one of the smallest document
            lead[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            goes = ids[row] > ids[row[lead]]
            g = np.flatnonzero(goes)
            first, ends = _stretches(row[g], at[g], row[lead[g]], at[lead[g]], window)
            out = []
            for r, a, e, sr, sa in zip(row[g][first].tolist(), at[g][first].tolist(), ends.tolist(), row[lead[g]][first].tolist(), at[lead[g]][first].tolist(), strict=True):
                own = words[r][a:e]
                if own == words[sr][sa : sa + e - a]:
                    out.append((a % buckets, None, None, None, None, None, int(ids[r]), a, e, None, None, digest(own)))
            k = np.flatnonzero(~goes)
            name = np.where(best[k] >= 0, names_[best[k]], h[k])
            begins = np.concatenate([[True], (best[k][1:] != best[k][:-1]) | (best[k][1:] < 0) | (row[k][1:] != row[k][:-1]) | (k[1:] != k[:-1] + 1)])
            f = np.flatnonzero(begins)
            count = np.diff(np.concatenate([f, [len(k)]]))
            bucket = (mix(name[f]) % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            f, count, bucket = f[by], count[by], bucket[by]
            take = np.repeat(f - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            short = h[k][take].view(np.uint8).reshape(-1, 8)[:, :6]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            upto = np.concatenate([[0], np.cumsum(count)])
            first_doc, first_at, first_name = ids[row[k[f]]], at[k[f]].astype(np.uint32), name[f]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                base = first_doc[a]
                delta = first_doc[a:z] - base
                packed = np.array([base], np.int64).tobytes() + (delta.astype(np.uint32) if delta.max(initial=0) < 1 << 32 and delta.min(initial=0) >= 0 else delta).tobytes()
                out.append((int(bucket[a]), first_name[a:z].tobytes(), packed, first_at[a:z].tobytes(), count[a:z].astype(_counts(window)).tobytes(), short[upto[a] : upto[z]].tobytes(), *[None] * 6))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _counts(window: int):
    """The type of how many windows share a symbol's place."""
    return np.uint8 if window < 256 else np.uint32


def _meet(window: int):
    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.is_valid(table.column("d"))).select(list(SPANS))
        syms, ids, ats, counts, hashes = [], [], [], [], []
        for r in table.filter(pa.compute.is_null(table.column("d"))).select(["sym", "doc", "at", "count", "hashes"]).to_pylist():
            s = np.frombuffer(r["sym"], U)
            base = np.frombuffer(r["doc"], np.int64, 1)[0]
            rest = np.frombuffer(r["doc"], np.uint32 if len(r["doc"]) - 8 == 4 * len(s) else np.int64, offset=8)
            syms.append(s)
            ids.append(base + rest.astype(np.int64))
            ats.append(np.frombuffer(r["at"], np.uint32))
            counts.append(np.frombuffer(r["count"], _counts(window)))
            hashes.append(np.frombuffer(r["hashes"], np.uint8).reshape(-1, 6))
        if not syms:
            return known
        sym, doc, at, count = np.concatenate(syms), np.concatenate(ids), np.concatenate(ats).astype(np.int64), np.concatenate(counts).astype(np.int64)
        wide = np.zeros((int(count.sum()), 8), np.uint8)
        wide[:, 2:] = np.concatenate(hashes)
        h = wide.view(U).ravel()
        by = np.argsort(sym, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], sym[by][1:] != sym[by][:-1]]))
        shared = np.minimum.reduceat(doc[by], first) < np.maximum.reduceat(doc[by], first)
        keep = np.zeros(len(sym), bool)
        keep[by] = np.repeat(shared, np.diff(np.concatenate([first, [len(sym)]])))
        rec = np.repeat(np.arange(len(sym)), count)
        k = np.flatnonzero(keep[rec])
        if not len(k):
            return known
        rec_k = rec[k]
        place = at[rec_k] + k - (np.cumsum(count) - count)[rec_k]
        own, key = doc[rec_k], h[k] | (mix(sym)[rec_k] & U(0xFFFF))
        by = np.lexsort((place, own, key))
        new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        lead = np.empty(len(k), np.int64)
        lead[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        g = np.flatnonzero(own > own[lead])
        first, ends = _stretches(own[g], place[g], own[lead[g]], place[lead[g]], window)
        columns = [own[g][first], place[g][first], ends, own[lead[g]][first], place[lead[g]][first], [None] * len(first)]
        return pa.concat_tables([known, pa.table({c: pa.array(v, t) for (c, t), v in zip(SPANS.items(), columns, strict=True)})])

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, rounds: int | None = None, bucket_bytes: int = 4 << 20) -> DataFrame:
    """All columns of docs, with `text` reduced to the kept words joined by one space, plus n_words and n_removed.

    Words are runs of other than ASCII white space, unchanged. A word goes if a window of `window` consecutive words
    covers it and the same words also start in a document with a smaller doc_id; windows are judged on the input.
    `rounds` of pairs follow the runs: as many as let a symbol and its context span the window, if not given.

    Null or empty text, or fewer words than a window: nothing goes; null text becomes ''. Null doc_id counts as the
    smallest. Repeats inside one document stay, and so do those between rows of one doc_id (they are one document). Extra columns
    pass through; columns named n_words or n_removed are replaced. An empty table gives an empty table.

    Shuffles: each distinct window of a batch once, as 6 bytes besides its symbol (equal windows agree in the symbol
    and 64 bits of hashes); the stretches to remove; the compressed texts. In each batch all but
    the smallest document of equal windows are settled before the shuffle, so a window that a third of all documents hold
    arrives once for each batch of documents. A stretch goes only if its words are those of its source (`digest`): different
    windows with equal hashes may leave a repeat in place, never remove other words.
    """
    prepare(docs.sparkSession)
    rounds = max(1, window.bit_length() - 1) if rounds is None else rounds
    buckets = min(max(64, -(-input_bytes(docs) // bucket_bytes)), 1 << 30)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    fields = "d long, start long, end long, src long, src_start long, digest binary"
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_deal(window, rounds, buckets), f"bucket int, sym binary, doc binary, at binary, count binary, hashes binary, {fields}")
    spans = written(dealt.groupBy("bucket").applyInArrow(_meet(window), fields), "spans")

    # the digest of each distinct source stretch, by regions of a document, so that no row holds all of a source's stretches
    wanted = spans.where("digest is null").select("src", "src_start", (F.col("end") - F.col("start")).alias("n")).distinct()
    wanted = wanted.groupBy("src", F.floor(F.col("src_start") / 4096).alias("region")).agg(F.collect_list(F.struct("src_start", "n")).alias("at"))

    @F.pandas_udf("array<binary>")
    def digests(text: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, at, strict=True):
            w = words_of(t, False)
            out.append([digest(w[x["src_start"] : x["src_start"] + x["n"]]) for x in own])
        return pd.Series(out)

    sources = docs.select(key.alias("__k"), "text").join(wanted, F.col("__k") == F.col("src")).select("src", "at", digests("text", "at").alias("own"))
    sources = sources.select("src", F.explode(F.arrays_zip("at", "own")).alias("x")).select("src", "x.at.src_start", "x.at.n", F.col("x.own").alias("own")).distinct()
    far = spans.where("digest is null").withColumn("n", F.col("end") - F.col("start")).drop("digest").join(sources, ["src", "src_start", "n"]).select("d", "start", "end", F.col("own").alias("digest"))
    lost = spans.where("digest is not null").select("d", "start", "end", "digest").union(far).groupBy(F.col("d").alias("__d")).agg(F.collect_set(F.struct("start", "end", "digest")).alias("__spans"))

    @F.pandas_udf("binary")
    def shut(text: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        return text.map(lambda t: c.compress((t or "").encode("utf-8", "surrogatepass")))

    @F.pandas_udf("text string, n_words long, n_removed long")
    def keep(packed: pd.Series, spans: pd.Series) -> pd.DataFrame:
        import zstandard

        d, rows = zstandard.ZstdDecompressor(), []
        for blob, own in zip(packed, spans, strict=True):
            words = d.decompress(blob).split()
            stays = np.ones(len(words), bool)
            for x in () if own is None else own:
                a, z = x["start"], x["end"]
                if z <= len(words) and digest(words[a:z]) == x["digest"]:
                    stays[a:z] = False
            left = words if stays.all() else [words[i] for i in np.flatnonzero(stays)]
            rows.append((b" ".join(left).decode("utf-8", "replace"), len(words), len(words) - len(left)))
        return pd.DataFrame(rows, columns=["text", "n_words", "n_removed"])

    small = docs.drop("n_words", "n_removed").withColumns({"__k": key, "text": shut("text")})
    out = small.join(lost, F.col("__k") == F.col("__d"), "left").withColumn("__out", keep("text", "__spans"))
    return out.withColumns({"text": F.col("__out.text"), "n_words": F.col("__out.n_words"), "n_removed": F.col("__out.n_removed")}).drop("__k", "__d", "__spans", "__out")
