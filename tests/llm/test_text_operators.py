"""Line dedup, substring dedup and sharding against plain forms of their contracts."""

import hashlib
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import line_dedup, sharding, substring
from tests.llm.helpers import corpus, empty, frame, words

LOW = -(2**63)


def test_line_dedup(spark):
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rows = [(LOW if r[0] is None else r[0], r[1] or "") for r in corpus()]
    for i, t in rows:
        for x in t.split("\n"):
            holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    kept = {i: [x for x in t.split("\n") if gone.get(key(x), i) == i] for i, t in rows}
    out = line_dedup.dedup_lines(frame(spark)).collect()
    got = {LOW if r["doc_id"] is None else r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out}
    assert got == {i: ("\n".join(kept[i]), t.count("\n") + 1, t.count("\n") + 1 - len(kept[i])) for i, t in rows}
    assert out[0]["shard"] == "clash" and any(r["n_dropped"] for r in out)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_repeated_rows_are_one_document(spark):
    line = "a line of twenty characters"
    rows = [(1, line, "", "", 1), (1, line, "", "", 1), (2, line, "", "", 1)]
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == {0}
    other = "another line of twenty characters"
    rows = [(None, f"{line}\n{i}\n{line}", "", "", 1) for i in range(3)] + [(None, f"x\n{line}", "", "", 1)] + [(i, f"{other}\n{line}\n{other}", "", "", 1) for i in (1, 2, 2, 3)]
    got = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(0, "0", 3, 2), (0, "1", 3, 2), (0, "2", 3, 2), (0, "x", 2, 1), (1, "", 3, 3), (2, "", 3, 3), (2, "", 3, 3), (3, f"{other}\n{line}\n{other}", 3, 0)]


@pytest.mark.parametrize("window", [13, 3, 300])
def test_substring_dedup(spark, window):
    more = [(200_000 + i, f"{i} {corpus()[-3][1][i:]}", "", "", 1) for i in range(3)]
    rows = [(LOW if r[0] is None else r[0], words(r[1])) for r in corpus() + more]
    first = {}
    for i, w in sorted(rows, key=lambda r: r[0]):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    want = {}
    for i, w in rows:
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                keep[p : p + window] = [False] * window
        want[i] = (" ".join(x for x, k in zip(w, keep, strict=True) if k), len(w), keep.count(False))
    out = substring.dedup_substrings(frame(spark, corpus() + more).repartition(5), window).collect()
    assert {LOW if r["doc_id"] is None else r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in out} == want
    assert sum(r["n_removed"] for r in out) > 1000
    assert substring.dedup_substrings(empty(spark)).count() == 0


def test_substring_windows_whose_hashes_agree_by_chance_stay(monkeypatch):
    """All windows have one hash: of those that seem to be the first one's, only what holds its words goes."""
    rows = pa.record_batch({"doc_id": [1, 2, 3], "text": ["a b c d e f", "u v w x y z", "k a b c d e f"]})
    monkeypatch.setattr(substring, "word_hashes", lambda: SimpleNamespace(of=lambda w: np.full(len(w), 5, np.uint64)))
    out = pa.Table.from_batches(list(substring._deal(3, 1, 4)([rows])))
    gone = out.filter(pc.is_valid(out.column("d")))
    assert gone.select(["d", "start", "end"]).to_pylist() == [{"d": 3, "start": 1, "end": 4}]
    assert substring.digest([b"a", b"b"]) != substring.digest([b"a", b"c"])


def test_recompression_names_alike():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 5, 60).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 5, k).astype(np.uint64), part, rng.integers(0, 5, 40).astype(np.uint64)]) for k in (10, 33)]
    found = []
    for k, t in zip((10, 33), texts, strict=True):
        names, cs, ce = substring.recompress(t)
        inside = (cs >= k) & (ce <= k + 60)
        found.append(list(zip(names[inside], cs[inside] - k, ce[inside] - k, strict=True)))
    assert found[0] == found[1] and len(found[0]) > 5


def test_sharding(spark):
    out = sharding.shard(frame(spark), shards=7, tolerance=0.05).collect()
    rows = [((r[1] or "").encode(), r[0]) for r in corpus()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((i is None, i or 0, len(t) + 16) for t, i in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    again = sharding.shard(frame(spark).repartition(3), shards=7, tolerance=0.05).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in out) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_are_near_equal_though_a_group_is_large(spark):
    rows = [(i, "same text " * 5 if i % 3 == 0 else hashlib.md5(str(i).encode()).hexdigest() * (1 + i % 4), "", "", 1) for i in range(3000)]
    out = sharding.shard(frame(spark, rows), shards=8, tolerance=0.01, range_bytes=5000).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * min(sizes.values())
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({zlib.crc32(r["text"].encode()) for r in out}) > 10


def test_groups_that_fit_a_shard_stay_whole(spark):
    rows = [(i, f"text number {i // 50}" * (1 + i // 50 % 5), "", "", 1) for i in range(4000)] + [(None, "null id", "", "", 1)] * 2
    places = defaultdict(set)
    for r in sharding.shard(frame(spark, rows), shards=7, tolerance=0.001).collect():
        places[r["text"]].add(r["shard"])
    assert len(places) == 81 and all(len(p) == 1 for p in places.values())


def test_bins_are_those_of_python():
    rng = np.random.default_rng(1)
    probes = sorted({(int(h), int(d)) for h, d in rng.integers(-3, 3, (30, 2))})
    h, d = rng.integers(-4, 4, (2, 500))
    got = sharding._bin_of(h, d, *(np.array(x, np.int64) for x in zip(*probes, strict=True)))
    assert got.tolist() == [sum(p <= k for p in probes) for k in zip(h.tolist(), d.tolist(), strict=True)]


def test_sharding_query(spark):
    from tessera.llm import queries

    d = "/root/testdata/sf0.001"
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = queries.op8_sharding(spark, d).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == want and {r["law"] for r in out} == {"bytes"}
    slots, groups, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
        sizes[r["text_crc32"]] += r["size"]
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sum(x for x, _ in want.values()) / 40
    assert all(len(g) == 1 for k, g in groups.items() if sizes[k] <= whole)
