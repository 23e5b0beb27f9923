"""Encoding, token index and packing: exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, token_index
from tessera.llm.encoding import encoder
from tests.llm.helpers import corpus, empty, frame

P = pytest.importorskip("public_tokenizers")
ODD = ["a  b", " x", "x ", "\n\n a", "a\tb\n c", "foo <|endoftext|> bar", "| a |", "it's don't", "a\n\nb", "e ́x", "", "\0", "你好 world", "x y z", "!!. ... a.b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    enc = encoder(P.path(name))
    texts = ODD + [r[1] or "" for r in corpus()[:40]]
    want = [np.array(e.ids, np.uint32).tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.ids(texts) == want and enc.ids(texts) == want and enc.ids([None]) == [b""]


def test_token_index(spark):
    enc = encoder(P.path("word_bpe_49k.json"))
    files = token_index.write_tokens(frame(spark), P.path("word_bpe_49k.json"), end_id=1, keys_per_bucket=20)
    got = {r["doc_id"]: r for r in token_index.read_tokens(files, frame(spark), ids=True).collect()}
    start = len(enc.ids([corpus()[-1][1]])[0]) // 4 + 1  # the row without a doc_id stands first and has no key
    for doc, text, *_ in sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0]):
        raw = enc.ids([text or ""])[0] + np.array([1], "<u4").tobytes()
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(raw) // 4, zlib.crc32(raw))
        assert r["ids"] == np.frombuffer(raw, "<u4").tolist()
        start += len(raw) // 4
    strangers = spark.createDataFrame([(i,) for i in range(1, 200, 3)], "doc_id long")
    assert token_index.read_tokens(files, strangers).count() == 0
    files = token_index.write_tokens(empty(spark), P.path("word_bpe_49k.json"), end_id=1)
    assert token_index.read_tokens(files, frame(spark)).count() == 0


def test_minimal_perfect_hash():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    keys = np.unique(keys)
    levels, slot = token_index.build_mph(keys)
    assert sorted(slot) == list(range(len(keys))) and (token_index.find_slots(levels, keys) == slot).all()
    blob = token_index.pack_index(keys, keys % 7 + 7, np.arange(len(keys)), np.arange(len(keys)) * 2)
    found, _, offset, _ = token_index.look_up(blob, keys)
    assert found.all() and (offset == np.arange(len(keys))).all()
    assert token_index.look_up(blob, keys + 1)[0].mean() < 0.01


def test_ids_do_not_depend_on_batches_or_memory(monkeypatch):
    from tessera.llm import encoding

    monkeypatch.setattr(encoding, "REMEMBER", 50)
    monkeypatch.setattr(encoding, "AT_ONCE", 100)
    rng = random.Random(9)
    parts = [*"abcDEF zé ß İ ſ ŉ ﬁ Σς 中文 ١٢3.,;:!?'-|<>\n\t", "'s", "'ll", "<|endoftext|>", "\r\n", "  ", " the", " Ünder.", "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = encoding.Encoder(P.path(name))
        assert enc.by_model
        ids, edges = enc.encode(pa.array(texts), 7)
        want = [[*e.ids, 7] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:z].tolist() for a, z in zip(edges[:-1], edges[1:], strict=True)] == want


def test_repeated_ids(spark):
    rows = [(1, "a b", "", "", 0), (1, "c", "", "", 0), (1, "a b", "", "", 0), (None, "c", "", "", 0), (None, "c", "", "", 0)]
    out = packing.pack(frame(spark, rows), P.path("byte_bpe_50k.json")).collect()
    assert sorted(r["length"] for r in out) == [2, 2, 2, 3, 3] and sorted(r["offset"] for r in out) == [0, 3, 6, 8, 10]
    files = token_index.write_tokens(frame(spark, rows), P.path("word_bpe_49k.json"), end_id=1)
    got = token_index.read_tokens(files, frame(spark, rows)).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["start"] == 4


def test_queries_keep_their_contracts(spark):
    """op1 and op4 over the smallest tables against the library, one document at a time."""
    from tessera.llm import queries

    d = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    enc = {n: encoder(P.path(n)).tokenizer for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    want, start = {}, 0
    for doc, text in docs:
        raw = np.array([*enc["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids, 1], "<u4")
        want[doc] = (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_token_index(spark, d).collect()} == want
    want = {}
    for doc, text in docs:
        raw = np.array([*enc["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = (len(raw) - 1) % 2048 + 1
        for piece, start in enumerate([0, *range(first, len(raw), 2048)]):
            own = raw[start : first if piece == 0 else start + 2048]
            want[doc, piece] = (start, len(own), zlib.crc32(own.tobytes()))
    out = queries.op4_best_fit_packing(spark, d).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    assert len({r["sequence_id"] for r in out}) <= _best_fit_decreasing([r["length"] for r in out], 2048)


def test_packing(spark):
    enc = encoder(P.path("byte_bpe_50k.json"))
    out = packing.pack(frame(spark), P.path("byte_bpe_50k.json"), end_id=0, capacity=256).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text, *_ in corpus():
        raw = enc.ids([text or ""])[0] + np.array([0], "<u4").tobytes()
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(raw) // 4
        assert all(r["length"] == 256 for r in own[1:]) and own[0]["length"] <= 256
        for r in own:
            assert zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(p), sorted(p)[1:] + [(sum(x[1] for x in p), 0)], strict=True)) and sum(x[1] for x in p) <= 256
    assert packing.pack(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def _best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_all_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(1, 257, 1500), np.clip(rng.normal(90, 20, 1500), 1, 256).astype(int), np.full(1000, 129), rng.choice([70, 90, 170, 256, 3], 1500)]
    lengths = kinds[seed % 4]
    h = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    rows = packing.plan(h, 256)
    fill, seen = {}, {k: 0 for k in h}
    for length, rank, n, first, offset in rows.tolist():
        assert rank == seen[length]
        seen[length] += n
        for s in range(first, first + n):
            fill.setdefault(s, []).append((offset, length))
    assert seen == h
    for p in fill.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert len(fill) <= _best_fit_decreasing(lengths.tolist(), 256)
