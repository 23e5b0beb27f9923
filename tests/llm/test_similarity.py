"""Jaccard join, vector dedup, decontamination against brute force."""

import random

import numpy as np
import pytest

from tessera.llm import decontam, embedding_dedup, ngram_join
from tessera.llm.common import components
from tests.llm.helpers import corpus, empty, frame, prose, smallest_reachable, words

LOW = -(2**63)


def ascii_lower(w):
    return w.encode().lower().decode()


@pytest.mark.parametrize(("k", "num", "leaders"), [(3, 90, 8), (5, 80, 1), (3, 93, 1)])
def test_jaccard_join(spark, monkeypatch, k, num, leaders):
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "SPREAD", 4)
    rows = [(LOW if r[0] is None else r[0], [ascii_lower(w) for w in words(r[1])]) for r in corpus()]
    sets = {i: {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()) for i, w in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert len(pairs) > 20
    want = smallest_reachable(sets, pairs)
    out = ngram_join.near_duplicates(frame(spark), k, num, 100).collect()
    low = lambda x: LOW if x is None else x
    assert {low(r["doc_id"]): (r["n_shingles"], low(r["component_id"])) for r in out} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_join_of_nothing(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("rare", [0, 40, 256])
@pytest.mark.parametrize("num", [80, 90])
def test_prefixes_share_a_key(rare, num):
    """Sets at or over the threshold share a key, whatever the levels."""
    rng = np.random.default_rng(5)
    level = rng.integers(0, 255, 1 << 10).astype(np.uint8)
    for _ in range(300):
        n = int(10 ** rng.uniform(0, 3.5))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        cut = int(len(a) * rng.uniform(0, 1.1 - num / 100))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, cut + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < num * (len(a) + len(b) - both):
            continue
        keys = [set(ngram_join.signatures(t, level[(t & np.uint64(1023)).astype(int)], rare, num, 100).tolist()) for t in (a, b)]
        assert keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(2000, x) for x in range(1500, 1600)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7), "a", "b").collect()}
    want = smallest_reachable({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


def _linked_vectors(rng):
    """Clusters, copies, other scales, and rows that link with nothing."""
    rows = []
    for i in range(400):
        base = rng.normal(size=64)
        for _ in range(1 + (i % 10 == 0) * 30):
            rows.append((len(rows), (base + rng.normal(size=64) * 0.14 * rng.uniform(0, 1)).astype(np.float32).tolist(), int(i % 3)))
    rows += [(len(rows) + i, rows[40][1], rows[40][2]) for i in range(60)]
    rows += [(len(rows), [2 * v for v in rows[50][1]], rows[50][2])]
    odd = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, rows[0][1], None), (9004, [None] + [1.0] * 63, 1), (9005, [1.0, 2.0], 1), (9006, [1.0, 2.0], 1), (9007, [], 1), (9008, [float("inf")] + [1.0] * 63, 1), (None, rows[0][1], 0), rows[5]]
    return rows, odd


@pytest.mark.parametrize(("options", "least"), [({"block": 50}, 0.999), ({"codebook": 16}, 0.998), ({"codebook": 6, "target_recall": 1, "block": 70}, 1)])
def test_vectors(spark, options, least):
    rows, odd = _linked_vectors(np.random.default_rng(0))
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS n_links", "'y' AS cell", "'z' AS row")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, **options).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert hit.sum() > 1000 and least * hit.sum() <= n.sum() and (n <= hit.sum(1)).all()
    want = smallest_reachable(range(len(x)), np.argwhere(hit).tolist())
    assert {i: got[i]["component_id"] for i in range(len(x))} == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(x)))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(9000, 9009)] == [(0, 9000), (0, 9001), (0, 9002), (0, 9003), (0, 9004), (1, 9005), (1, 9005), (0, 9007), (0, 9008)]
    assert (got[None]["component_id"], got[None]["kept"]) == (None, False)
    assert embedding_dedup.near_duplicate_vectors(df).count() == len(rows) + len(odd)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_traversal_is_in_order():
    rng = np.random.default_rng(3)
    for _ in range(50):
        u, v = (np.sort(rng.dirichlet(np.ones(n)))[::-1] for n in rng.integers(1, 7, 2))
        seen = list(embedding_dedup.in_order(u.tolist(), v.tolist()))
        assert len({(i, j) for _, i, j in seen}) == len(u) * len(v)
        assert [p for p, *_ in seen] == sorted((u[:, None] * v).ravel().tolist(), reverse=True)
    p1, p2 = np.array([[0.6, 0.1, 0.3]]), np.array([[0.2, 0.8]])
    assert embedding_dedup.visited(p1, p2, 0.7) == [[(0, 1), (2, 1)]]


def _edit(rng, text, share):
    x = list(text)
    for _ in range(int(share * len(x))):
        p = rng.randrange(len(x))
        x[p : p + 1] = rng.choice([["q"], [], [x[p], "z"]])
    return "".join(x)


def test_decontamination(spark):
    rng = random.Random(1)
    made = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    items = [(i, made(40)) for i in range(6)] + [(6, None), (7, "short"), (None, made(40))]
    rows, planted = [], set()
    for i in range(60):
        text = prose(rng, 80)
        if i % 4 == 0:
            text = f"{text[:100]} {_edit(rng, items[i % 6][1].upper(), (i % 3) * 0.02)}\n{text[100:]}"
            planted.add((i, items[i % 6][0]))
        rows.append((i, text, "", "", 1))
    rows += [(100, None, "", "", 1), (101, "", "", "", 1), (None, items[0][1], "", "", 1), (103, items[8][1], "", "", 1), rows[0]]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS edits")
    for block in (16 << 20, 400):  # one pass, and several
        out = decontam.find_contamination(frame(spark, rows), bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in out} == planted | {(None, 0), (103, None)}
        assert all(0 <= r["doc_start"] < r["doc_end"] and r["edits"] <= 6 for r in out)
    assert decontam.find_contamination(empty(spark), bench).count() == 0
    assert decontam.find_contamination(frame(spark, rows), bench.limit(0)).count() == 0


def test_banded_alignment():
    rng = random.Random(0)
    for _ in range(200):
        p, t, k = [rng.randrange(3) for _ in range(rng.randint(1, 11))], [rng.randrange(3) for _ in range(rng.randint(1, 19))], rng.randrange(5)
        before = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            row = [i + 1]
            for j, d in enumerate(t):
                row.append(min(before[j] + (c != d), before[j + 1] + 1, row[j] + 1))
            before = row
        got = decontam.edits_within(np.array(p), np.array(t), k)
        assert (got is None) == (min(before) > k) and (got is None or got[0] == min(before))


def _spans(text, pattern, window=80, rate=0.075):
    """(item start, end, edits) over every window of the pattern that text holds within the bound, by plain alignment."""
    codes, item = decontam._codes(decontam.normal(text)), decontam._codes(decontam.normal(pattern))
    w = min(window, len(item))
    got = {s: decontam.edits_within(item[s : s + w], codes, int(rate * w)) for s in range(len(item) - w + 1)}
    held = {s: e[0] for s, e in got.items() if e}
    return (min(held), max(held) + w, max(held.values())) if held else None


def _found(texts, items):
    index = decontam.index_items(list(enumerate(items)), 10, 10, 80, 0.075)
    return {(m[0], m[1]): (m[4], m[5], m[6]) for m in decontam._matches(texts, index, 80, 0.075)}


def test_passages_from_the_middle_of_items(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    item = letters(300)
    texts = [letters(50) + item[100:180] + letters(50)]
    for i in range(40):
        part = list(item[(a := rng.randint(20, 180)) : a + rng.randint(80, 99)])
        for _ in range(i % 18):
            j = rng.randrange(len(part))
            part[j : j + rng.randrange(2)] = rng.choice(["", "x", "y"])
        texts.append(letters(30) + "".join(part) + letters(60 if i % 2 else 0))
    want = {(i, 0): s for i, t in enumerate(texts) if (s := _spans(t, item))}
    assert _found(texts, [item]) == want and (0, 0) in want and 20 < len(want) < 41


def test_other_items_of_a_block_hide_nothing():
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    item = letters(80)
    part = list(item)
    for j in (11, 22, 33, 44, 55, 66):
        part[j] = "z"
    text = letters(40) + "".join(part) + letters(40)
    want = {(0, 0): (0, 80, 6)}
    assert want == {(0, 0): _spans(text, item)}
    for n in (53, 66, 79):
        assert _found([text], [item, letters(n)]) == want


def test_short_items():
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items = [letters(n) for n in range(10, 45)] + [letters(200), letters(9)]
    texts, want = [], set()
    for n, item in enumerate(items):
        for edits in range(5):
            part = list(item)
            for _ in range(edits):
                j = rng.randrange(len(part))
                part[j : j + rng.randrange(2)] = rng.choice(["", "x", "y"])
            texts.append(f"{letters(30)} {''.join(part)}. {letters(30)}")
    for i, t in enumerate(texts):
        for n, item in enumerate(items[:-1]):
            if len(item) >= 14 and _spans(t, item):
                want.add((i, n))
            elif len(item) < 14 and t.split(" ")[1].rstrip(".") == item:
                want.add((i, n))
    index = decontam.index_items(list(enumerate(items)), 10, 10, 80, 0.075)
    assert len(index) > 2
    assert {m[:2] for m in decontam._matches(texts, index, 80, 0.075)} == want and len(want) > 60


def test_short_items_cut_no_word():
    index = decontam.index_items([(0, "the capital"), (1, "北京是中国的首都城市")], 10, 10, 80, 0.075)
    texts = ["(The  CAPITAL), it is", "bathe capitals", "the capitals", "我们知道北京是中国的首都城市吗", "the capital", None, ""]
    assert sorted(m[:2] for m in decontam._matches(texts, index, 80, 0.075)) == [(0, 0), (3, 1), (4, 0)]


def test_exact_setting_finds_short_items_anywhere():
    rng = random.Random(9)
    items = ["".join(rng.choices("abc ", k=rng.randint(1, 13))) for _ in range(40)]
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 60))) for _ in range(60)]
    index = decontam.index_items(list(enumerate(items)), 10, 1, 80, 0.075, whole_words=False)
    kept = [(i, p) for i, p in enumerate(map(decontam.normal, items)) if p]
    want = {(t, i) for t, text in enumerate(texts) for i, p in kept if p in decontam.normal(text)}
    assert {m[:2] for m in decontam._matches(texts, index, 80, 0.075)} == want and len(want) > 100
