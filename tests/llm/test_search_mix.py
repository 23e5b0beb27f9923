"""Ranked search, whitening and mixing against plain forms of their contracts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import impact_search, mixing, whitening
from tests.llm.helpers import corpus, empty, frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, all_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 75 + (25 * c.total() * n_docs) // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in plain_terms(text) if w in c)
            found += [(-s, -math.inf if d is None else d)] if s > 0 else []
        out += [(item, r + 1, None if d == -math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return out


ITEMS = [(1, "w1 w2 w3 p7 W7"), (2, "A line that is found, really"), (3, None), (4, "zzz"), (5, "w0"), (5, "one two"), (None, "la x la la"), (7, " ".join(f"w{i}" for i in range(200))), (8, "É éa Straße ١٢")]


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("block", [(1_000_000, 50_000), (300, 7)])
def test_search_equals_plain_scores(spark, block, monkeypatch):
    monkeypatch.setattr(impact_search, "BLOCK_POSTINGS", block[0])
    monkeypatch.setattr(impact_search, "BLOCK_DOCS", block[1])
    rows = corpus(5) + [(9, "Éa STRASSE straße ١٢ éa", "en", "s", 1), (9, "É é w1", "en", "s", 1), (0, corpus(5)[0][1], "en", "s", 1)]
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, score string")
    want = plain_search([(r[0], r[1]) for r in rows], ITEMS, 20)
    for block_terms in (200_000, 6):
        assert rows_of(impact_search.search(frame(spark, rows).repartition(3), items, 20, block_terms)) == sorted(want, key=repr)


def test_search_stops_early_and_stays_exact():
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randint(5, 60), vocabulary=3000)) for i in range(4000)] + [(9000 + i, "rare0 rare1 rare2 " + prose(rng, 9)) for i in range(25)]
    items = [(0, "rare0 rare1 rare2 w0 w1"), (1, prose(rng, 12, vocabulary=3000))]
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    words = {w: i for i, w in enumerate(sorted({w for _, t in items for w in plain_terms(t)}))}
    n_docs, all_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    own = [[(words[w], n) for w, n in c.items() if w in words] for _, c in counts]
    flat = np.array([x for o in own for x in o], np.int64)
    block = impact_search.Block(np.array([d for d, _ in docs]), [c.total() for _, c in counts], np.array(list(map(len, own))), flat[:, 0], flat[:, 1], len(words), n_docs, all_terms)
    want = plain_search(docs, items, 20)
    for item, text in items:
        q = [(words[w], c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))) for w, c in Counter(plain_terms(text)).items() if df[w]]
        score, doc = block.best(*(np.array([p[i] for p in q], np.int64) for i in (0, 1)), 20, 0)
        assert [(item, r + 1, int(d), int(s)) for r, (s, d) in enumerate(zip(score, doc, strict=True))] == [w for w in want if w[0] == item]
    assert len(block.group_impact) < len(flat)  # postings of one impact are one group


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert impact_search.search(empty(spark), items).count() == 0
    assert impact_search.search(frame(spark), items.limit(0)).count() == 0
    assert impact_search.search(frame(spark).withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_long_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr(impact_search, "_SLICE", 5)
    text = "Abc defghijklmnop é1 " * 9 + "x"
    assert [w.decode() for words in impact_search.terms_of(text) for w in words] == plain_terms(text)


VECTORS = "vec_id long, embedding array<float>, label int, component string"


def vectors(seed=4, n=60, d=12):
    rng = np.random.default_rng(seed)
    base = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 8).astype(np.float32)
    rows = [(i * 2, [float(c) for c in v], 1, "clash") for i, v in enumerate(base)]
    odd = [(501, None, 1, ""), (502, [1.0] * (d - 1) + [None], 1, ""), (503, [math.nan] + [0.5] * (d - 1), 1, ""), (504, [math.inf] * d, 1, ""), (505, [], 1, ""), (506, [0.5, 0.25], None, ""), (507, [3e38] * d, 1, "")]
    return rows + [rows[3], rows[3], (None, rows[5][1], None, None)], odd


def test_whitening_equals_numpy(spark):
    good, odd = vectors()
    out = whitening.whiten(spark.createDataFrame(good + odd, VECTORS).repartition(4))
    got = sorted(((r.component, (r.vec_id is not None, r.vec_id), r.deviation), r) for r in out.collect())
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) + 100_000 for _, v, *_ in good])
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    values, columns = np.linalg.eigh(z.T @ z / n)
    values, columns = values[::-1], columns[:, ::-1]
    assert len(got) == 8 * n and {r.n for _, r in got} == {n}
    order = sorted(range(n), key=lambda i: (good[i][0] is not None, good[i][0] or 0))
    for c in range(8):
        own = [r for (k, *_), r in got if k == c + 1]
        assert [r.vec_id for r in own] == [good[i][0] for i in order]
        assert [r.deviation for r in own] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in order]
        want = (z @ columns[:, c] / np.sqrt(values[c]))[order]
        have = np.array([r.whitened for r in own])
        assert np.allclose(have, want, atol=1e-8) or np.allclose(have, -want, atol=1e-8)
        assert all(abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 for r in own)
    assert {r.identity_error for _, r in got}.pop() < 1e-9


def test_whitening_passes_over_more_pairs_than_one_aggregation(spark, monkeypatch):
    good, _ = vectors()
    df = spark.createDataFrame(good, VECTORS)
    whole = {(r.vec_id, r.component, r.whitened) for r in whitening.whiten(df, components=3).collect()}
    monkeypatch.setattr(whitening, "PAIRS", 7)
    assert {(r.vec_id, r.component, r.whitened) for r in whitening.whiten(df, components=3).collect()} == whole


def test_whitening_without_variance(spark):
    for rows in ([], vectors()[1], vectors()[1][:5], [(1, [0.5, 0.5], 1, "")], [(i, [0.5, 0.5], 1, "") for i in range(3)], [(1, [], 1, ""), (2, [], 1, "")]):
        out = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert out.count() == 0 and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(spark.createDataFrame([(i, [0.5, i / 7, 2.0], 1, "") for i in range(9)], VECTORS)).collect()
    assert {r.component for r in flat} == {1} and {round(r.explained, 9) for r in flat} == {1.0}


def test_deviations_beyond_a_long_are_null():
    import pyarrow as pa

    w = whitening.Whitening(10**9, [10**15, 7], np.eye(2), np.ones(2), 2.0)
    b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[10.0**6, 0.0], [2.0**51, 5.0]])], ["vec_id", "x"])
    out = next(whitening._projector(w, 2)(iter([b])))
    assert out.column(1).to_pylist() == [49, None]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return out


def sourced(n=900, seed=6):
    rng = random.Random(seed)
    rows = [(i, prose(rng, int(rng.paretovariate(0.9)) % 700 + 1), None, rng.choice(["b", "b", "b", "b", "a", "É", "z", None, "c"]), 0) for i in range(n)]
    rows += [(i, None if i % 2 else " \n", None, "b", 0) for i in range(5000, 5004)] + [(6000, "only one", None, "solo", 0), (6001, "", None, "bare", 0)]
    return rows + [rows[5]] * 40 + [(rows[5][0], "other words here", None, "b", 0), (None, "some words", None, None, 0), (None, "some words", None, None, 0)]


@pytest.mark.parametrize("rows_at_once", [2000, 8])
def test_mix_meets_its_targets(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(mixing, "OPEN_ROWS", rows_at_once)
    rows = sourced()
    got = mixing.mix(frame(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((d is not None, d or 0, len((t or "").split())) for d, t, *_ in rows)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = plain_targets(sizes)
    for s, size in sizes.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size} and all(r.target == pytest.approx(targets[s]) for r in own)
        assert all(r.taken == r.copies * r.size <= 2 * r.size and abs(r.copies - targets[s] / max(size, 1)) < 1 for r in own if r.size)
        assert abs(sum(r.taken for r in own) - targets[s]) <= max(2, (0.004 if rows_at_once > 100 else 0.06) * targets[s])  # a short stretch has few that fit
    again = mixing.mix(frame(spark, rows[::-1]).repartition(2)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_ranks_by_odds(spark):
    """Without the border, exactly the documents with odds(u) < c * odds(p) go in; larger ones as often as smaller ones."""
    rows = [(i, "w " * (1 + i % 9), None, "s" if i % 5 else "t", 0) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), weights=(3, 1), share=0.9).collect()
    for s in "st":
        own = [r for r in got if r.source == s]
        p = own[0].target / own[0].source_size
        for size in range(1, 10):
            here = [r.copies for r in own if r.size == size]
            assert abs(sum(here) / len(here) - p) < 5 * math.sqrt(0.25 / len(here))


def test_mix_by_document_weights(spark):
    rows = sourced(300)
    df = frame(spark, rows).withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 4.0).when(F.col("doc_id") % 3 == 1, 1.0))
    got = mixing.mix(df, weight=F.col("quality")).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert all(r.copies <= 2 for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= max(3, 0.02 * own[0].target)
    liked = [r.copies for r in got if r.size and r.doc_id is not None and r.doc_id % 3 == 0]
    others = [r.copies for r in got if r.size and r.doc_id is not None and r.doc_id % 3]
    assert sum(liked) / len(liked) > 1.3 * sum(others) / len(others)


def test_draw_gives_the_taken_words(spark):
    df = frame(spark, sourced(200))
    plan = mixing.mix(df)
    out = mixing.draw(df, plan)
    assert out.columns == df.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == plan.agg(F.sum("taken")).first()[0]


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
    bare = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", 0), (2, "", None, "a", 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in bare] == [(0, 0.0, 0)] * 3
