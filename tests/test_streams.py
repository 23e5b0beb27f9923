"""Streams with timers and state that expires: retries, generations, conversations, restarts."""

import time

import pytest

from tessera.streaming import retry, sessions


@pytest.fixture
def rocks(spark):
    spark.conf.set(*retry.STORE)
    yield spark
    spark.conf.unset(retry.STORE[0])


def until(check, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.5)
    return False


def rows(spark, path):
    try:
        return spark.read.parquet(path).collect()
    except Exception:
        return []


def test_failing_files_are_tried_again_after_a_wait(rocks, tmp_path):
    inbox, tries = tmp_path / "inbox", tmp_path / "tries"
    inbox.mkdir()
    tries.mkdir()
    folder = str(tries)

    def parser(name, content):
        import os
        import uuid

        n = sum(f.startswith(name) for f in os.listdir(folder))
        open(f"{folder}/{name}-{n}-{uuid.uuid4().hex}", "w").close()
        if name == "never.txt" or name == "third.txt" and n < 2:
            raise ConnectionError(f"try {n + 1}")
        return [(None, content.decode())]

    for name in ("good.txt", "third.txt", "never.txt"):
        (inbox / name).write_text(f"text of {name}")
    from tessera.streaming.ingest import read_files

    out, dead = f"file://{tmp_path}/chunks", f"file://{tmp_path}/dead"
    q = retry.ingest_with_retries(read_files(rocks, f"file://{inbox}", stream=True), out, dead, f"file://{tmp_path}/checkpoint", parser=parser, wait_ms=1500)
    try:
        assert until(lambda: len(rows(rocks, dead)) == 1 and len(rows(rocks, out)) == 2), q.exception()
    finally:
        q.stop()
    got = {r["path"].rpartition("/")[2]: r for r in rows(rocks, out)}
    assert {n: (r["content"], r["attempts"]) for n, r in got.items()} == {"good.txt": ("text of good.txt", 1), "third.txt": ("text of third.txt", 3)}
    (last,) = rows(rocks, dead)
    assert last["attempts"] == 5 and last["error"] == "ConnectionError: try 5"
    assert last["tried_ms"] - got["good.txt"]["tried_ms"] >= 4 * 1500


def _events(spark, seed=3, n=400):
    import random
    from datetime import datetime, timedelta

    rng, at, out = random.Random(seed), datetime(2024, 1, 1), []
    for _ in range(n):
        at += timedelta(seconds=rng.choice([1, 20, 200, 900]), microseconds=rng.randrange(10**6))
        out.append((rng.randrange(4), at, rng.choice(["chunk"] * 6 + ["completed", "failed", "cancelled"])))
    return spark.createDataFrame(out, "user_id long, ts timestamp, kind string"), out


def _plain(events, seconds, renewed):
    from datetime import timedelta

    ttl, out, state = timedelta(seconds=seconds), [], {}
    ends = {"completed": "COMPLETED", "failed": "FAILED", "cancelled": "CANCELLED"}

    def close(u):
        s = state.pop(u)
        e = (s["last"] if renewed else s["began"]) + ttl
        out.append((u, s["began"], s["status"] or "STREAMING", s["chunks"], s["ended"] or e, e) if renewed else (u, s["began"], e, s["n"]))

    for u, ts, kind in events:
        if u in state and ts >= state[u]["last" if renewed else "began"] + ttl:
            close(u)
        s = state.setdefault(u, {"began": ts, "chunks": 0, "status": None, "ended": None, "n": 0})
        s["last"], s["n"] = ts, s["n"] + 1
        if s["status"] is None:
            if kind in ends:
                s["status"], s["ended"] = ends[kind], ts
            else:
                s["chunks"] += 1
    for u in list(state):
        close(u)
    return sorted(out)


def test_generations_and_conversations_batch_equals_stream(rocks, tmp_path):
    from datetime import datetime

    df, events = _events(rocks)
    want = {"g": _plain(events, 1200, True), "c": _plain(events, 5000, False)}
    assert sorted(map(tuple, sessions.generations(df, 1200).collect())) == want["g"]
    assert sorted(map(tuple, sessions.conversations(df.repartition(3), 5000).collect())) == want["c"]
    half = len(events) // 2
    parts = [events[:half], events[half:], [(99, datetime(2024, 3, 1), "chunk")], [(99, datetime(2024, 6, 1), "chunk")]]
    for i, p in enumerate(parts):
        rocks.createDataFrame(p, df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = lambda: rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for name, make in (("g", lambda: sessions.generations_stream(source(), 1200)), ("c", lambda: sessions.conversations_stream(source(), 5000))):
        out = f"{tmp_path}/out-{name}"
        for _ in range(2):  # a second start goes on from the checkpoint and repeats nothing
            make().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start(out).awaitTermination()
        assert sorted(tuple(r) for r in rocks.read.parquet(out).where("user_id < 99").collect()) == want[name]


def test_tasks_are_published_once(spark, tmp_path):
    ledger, schema = f"file://{tmp_path}/ledger", "file_md5 string, url string"
    first = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("b", "u2")], schema)
    got = lambda df: sorted(map(tuple, retry.publish_once(df, ledger, "file_md5").collect()))
    assert got(first) == got(first) == [("a", "u1"), ("b", "u2")]  # a batch that runs again gives the same
    assert got(spark.createDataFrame([("b", "other"), ("c", "u3"), (None, "x")], schema)) == [("c", "u3")]
    assert got(spark.createDataFrame([("a", "u1")], schema)) == []
    assert got(spark.createDataFrame([], schema)) == []
