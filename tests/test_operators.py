"""Small cases worked out by hand."""

import datetime as dt
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values
from tessera.operators import access, chunking, control, files, memory, retrieval, usage
from tessera.plans import search
from tessera.streaming import ingest, limits


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "tokens"), [("abcd", 14), ("你好", 14), ("   ", 0), (None, 0), ("🙂", 14), ("a b\tc", 13)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, tx.estimate_tokens(F.lit(text).cast("string"))) == tokens


def test_embedding_tokens(spark):
    assert one(spark, tx.estimate_embedding_tokens(F.lit(36))) == 42
    assert one(spark, tx.estimate_embedding_tokens(F.lit(None).cast("long"))) == 0


LINES = [("1. item", "CHAPTER_HEADING"), ("1.1 x", "SECTION_HEADING"), ("- x", "LIST_ITEM"), ("## 第一章", "PARAGRAPH"), ("|a|", "TABLE_ROW"), ("|---|", "TABLE_SEPARATOR"), ("```py", "CODE_BLOCK"), ("  ", "EMPTY_LINE"), ("第一章 起", "CHAPTER_HEADING")]


@pytest.mark.parametrize(("line", "kind"), LINES)
def test_line_types(spark, line, kind):
    assert one(spark, tx.line_type(F.lit(line))) == kind
    assert chunking.line_kind(line) == kind


def test_text_functions(spark):
    assert set(one(spark, tx.memory_tokens(F.lit("Ab 你好吗 x")))) == {"ab", "你", "好", "吗", "你好", "好吗"}
    assert one(spark, tx.boundary_key(F.lit(" Report   Page 12 "))) == "report page #"
    assert one(spark, tx.boundary_key(F.lit("abc"))) is None
    assert one(spark, tx.nfkc(F.lit("ＡＢ①"))) == "AB1"
    assert one(spark, tx.tag_slug(F.lit("R & D!"))) == "ORG_r-d"
    assert one(spark, tx.tag_slug(F.lit("研发"))) == "ORG_tag"
    assert one(spark, tx.anchor_text(F.lit(" \n "))) is None
    assert one(spark, tx.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, tx.evidence_snippet(F.lit(None).cast("string"), F.lit("短。This is a long enough sentence. 完！"))) == "This is a long enough sentence. 完！"


def test_values(spark):
    assert [one(spark, values.yuan_to_cents(F.lit(x))) for x in ("12.345", "12.346", "0")] == [1234, 1235, 0]
    assert [one(spark, values.cents_to_yuan(F.lit(x))) for x in (1200, 1250, 1234)] == ["12", "12.5", "12.34"]
    bitmap = F.lit(bytearray([0b10100000, 0b00000001]))
    assert [i for i in range(24) if one(spark, values.part_received(bitmap, F.lit(i)))] == [0, 2, 15]
    assert one(spark, values.parse_time(F.lit("2024-01-02T03:04"))) == dt.datetime(2024, 1, 2, 3, 4)
    assert one(spark, values.parse_time(F.lit("soon"))) is None
    told = '```json\n[{"content":" a  fact ","type":"ODD","confidence":0.9},{"content":"abc","confidence":0.9},{"content":"weak fact","confidence":0.1}]\n```'
    assert [tuple(f) for f in one(spark, values.facts(F.lit(told)))] == [("a fact", "FACT", "USER", 0.9)]
    assert one(spark, values.context_trigger(F.lit(1000), F.lit(2.0))) == 7840


@pytest.mark.parametrize(("text", "size", "overlap", "pieces"), [("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]), ("", 4, 1, []), ("abc", 4, 1, ["abc"]), ("abcde", 4, 0, ["abcd", "e"])])
def test_character_pieces(spark, text, size, overlap, pieces):
    assert one(spark, chunking.character_pieces(F.lit(text), size, overlap)) == pieces


def test_overlap_before_chunks(spark):
    df = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb")], "doc_id int, chunk_id int, content string")
    assert [r["content"] for r in chunking.with_overlap(df, "doc_id", 2).orderBy("chunk_id").collect()] == ["aaaa", "aabbbb"]


def test_empty_texts_keep_their_row_as_in_the_sql(spark, tmp_path):
    texts = spark.createDataFrame([(1, ""), (2, None), (3, "a" * 401)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(search.CATALOG["chunk_lag_overlap"][1]).fetchall()
    assert len(want) == 4 and sorted(map(tuple, search.chunk_lag_overlap(spark, str(tmp_path)).collect())) == sorted(want)
    assert search.chunks(spark, str(tmp_path)).count() == 1


def test_fixed_chunks():
    assert chunking.fixed_chunks("a" * 30 + "\n\n" + "b" * 30, 50) == ["a" * 30, "aaaaa" + "b" * 30]
    assert chunking.fixed_chunks("one. two. three.", 9) == ["one.two.", "three."]
    assert chunking.fixed_chunks("\n\n\n") == []
    long_ = chunking.fixed_chunks("word " * 300, 100)
    assert all(len(c) <= 110 for c in long_) and long_[0].startswith("word")


def test_smart_chunks():
    assert chunking.coherent("如下：", "x") and chunking.coherent("a" * 200 + ".", "因此 b") and not chunking.coherent("a" * 200 + ".", "b")
    assert chunking.coherent("a" * 150 + ".\n" + "b" * 50 + ".", "c")  # several lines always count as unfinished
    assert not chunking.coherent("short", "1. chapter")
    text = "Chapter 1 One\n\n" + "x" * 300 + ".\n\nChapter 2 Two\n\n" + "y" * 300 + "."
    parts = chunking.smart_chunks(text)
    assert len(parts) == 2 and parts[1].startswith("x" * 50 + ".")
    assert chunking.smart_chunks("\n") == []


def test_fusion(spark):
    rows = lambda keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys, 1)], "key string, rank int")
    out = retrieval.fuse(rows("AB"), rows("BC"), ["key"], 3).orderBy("rank").collect()
    assert [r["key"] for r in out] == ["B", "A", "C"]
    assert out[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert [r["key"] for r in retrieval.fuse(rows("AB"), None, ["key"], 3).orderBy("rank").collect()] == ["A", "B"]


def test_access(spark):
    df = spark.createDataFrame([(1, 7, False, "x"), (2, 8, True, "x"), (3, 8, False, "t"), (4, 8, False, "x"), (5, 8, None, None)], "i int, user_id int, is_public boolean, org_tag string")
    assert [r["i"] for r in df.where(access.visible(7, ["t"])).orderBy("i").collect()] == [1, 2, 3]
    assert [r["i"] for r in df.where(access.resource_allowed("7", "USER", [])).orderBy("i").collect()] == [1, 2, 5]
    tags = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "tag_id string, parent_tag string")
    users = spark.createDataFrame([(1, "c"), (2, "gone")], "id int, org_tags string")
    got = {(r["id"], r["tag"]) for r in access.effective_tags(users, tags).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (1, "DEFAULT"), (2, "gone"), (2, "DEFAULT")}
    moves = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "a")], "tag_id string, new_parent string")
    assert {(r[0], r[1]): r[2] for r in access.reparenting_cycles(tags, moves).collect()} == {("a", "c"): True, ("c", "a"): False, ("a", "a"): True}


def test_anchored_window():
    state, verdicts = None, []
    for at in (50, 70, 100, 111):
        state, ok = usage.anchored_limit(state, at, 2, 60)
        verdicts.append(ok)
    assert verdicts == [True, True, False, True]


def test_ledger_and_alerts(spark):
    rows = [(1, "u", "2024-01-01", "LLM", "CONSUME", 100), (2, "u", "2024-01-01", "LLM", "CONSUME", 50)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, record_date string, token_type string, change_type string, amount long")
    assert tuple(usage.daily_ledger(df, 1000).first()[3:]) == (150, 2, 1000, 850)
    snap = spark.createDataFrame([("a", "LLM", 100, 0, 1.0), ("b", "LLM", 90, 10, 0.9), ("c", "LLM", 80, 20, 0.8), ("d", "LLM", 0, 100, 0.0)], "user_id string, token_type string, used long, remaining long, ratio double")
    assert [r["user_id"] for r in usage.alerts(snap, 100).orderBy("rank").collect()] == ["b", "c", "a"]
    assert [r["user_id"] for r in usage.alerts(snap, 100, critical_first=True).orderBy("rank").collect()] == ["a", "b", "c"]


def test_daily_quota(spark):
    df = spark.createDataFrame([(1, "u", 1, 100), (2, "u", 1, 200), (3, "u", 1, 150)], "event_id long, user_id string, record_date int, amount long")
    assert [r["accepted"] for r in usage.daily_quota(df, 250).orderBy("event_id").collect()] == [True, False, True]


def test_memory(spark):
    roles = ["system", "user", "assistant", "user", "assistant", "user"]
    df = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id int, turn int, role string, text string")
    split = memory.split_for_compaction(df, 2).orderBy("turn").collect()
    assert [r["summarise"] for r in split] == [True, True, True, False, False, False]
    assert not any(r["summarise"] for r in memory.split_for_compaction(df, 4).collect())
    budget = spark.createDataFrame([(1, 3, 40), (1, 2, 70), (1, 1, 10)], "k int, at int, tokens int")
    assert [r["at"] for r in memory.within_budget(budget, "k", [F.desc("at")], "tokens", 100).collect()] == [3]
    assert memory.budget_shares(1200) == (600, 600)
    calls = []
    out = memory.compact(df, lambda texts: "+".join(texts), 2, 1).collect()
    assert out[0]["summary"] == "t0\nt1+t2\nt3+t4" and not calls
    seen = spark.createDataFrame([(1, i, v) for i, v in enumerate("aaab")], "k int, i int, v string")
    assert [r["stagnant"] for r in memory.runs(seen, "k", "i", "v").orderBy("i").collect()] == [False, False, True, False]


def test_files(spark):
    pages = spark.createDataFrame([("f", i, f"Report Page {i}\nbody {'xyz'[i] * 5}\nthe end") for i in range(3)], "file string, page int, text string")
    keys = {(r["side"], r["key"]): r["pages"] for r in files.boundary_lines(pages, "file", "page").collect()}
    assert keys["top", "report page #"] == 3
    assert one(spark, files.preview(F.lit("ab\ncd\nef"), 4)) == ["ab", "cd"]
    assert one(spark, files.html_text(F.lit("<p>a&amp;b</p><script>x</script> c"))) == "a&b c"


def test_control(spark):
    fields = "config_key string, single_max int, single_window_seconds long, minute_max long, minute_window_seconds long, day_max long, day_window_seconds long"
    defaults = spark.createDataFrame([("login", 10, 60, None, None, None, None), ("llm", None, None, 5, 60, 50, 86400)], fields)
    stored = spark.createDataFrame([("login", 3, 30, None, None, None, None), ("llm", None, None, 7, None, 70, 86400), ("odd", 1, 1, None, None, None, None)], fields)
    got = {r[0]: tuple(r[1:]) for r in control.effective_limits(defaults, stored).collect()}
    assert got == {"login": (3, 30, None, None, None, None), "llm": (None, None, 5, 60, 50, 86400)}
    codes = spark.createDataFrame([("ABC123", 2, 1, True, None), ("OLD", 5, 0, True, dt.datetime(2020, 1, 1))], "code string, max_uses int, used_count int, enabled boolean, expires_at timestamp")
    asked = spark.createDataFrame([(1, "abc123"), (2, "abc123"), (3, "old"), (4, "no"), (5, " ")], "request_id int, code string")
    out = control.consume_invites(asked, codes, F.lit(dt.datetime(2024, 1, 1))).orderBy("request_id").collect()
    assert [r["verdict"] for r in out] == ["OK", "INVITE_CODE_EXHAUSTED", "INVITE_CODE_EXPIRED", "INVITE_CODE_INVALID", "INVITE_CODE_REQUIRED"]
    mib = 1 << 20
    cases = [(2 * mib, 0, 1, mib, False), (2 * mib, 0, 1, mib, True), (mib, 1, 1, 5 * mib, False), (mib, 0, mib, 5 * mib, False)]
    assert [one(spark, control.upload_rejected(*map(F.lit, c))) for c in cases] == [True, False, True, False]
    assert one(spark, control.assign_tags(F.lit("a,PRIVATE_x"), F.array(F.lit("b")))) == ["b", "PRIVATE_x"]


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(seconds=11 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = limits.anchored_windows_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 2, 60)
    q = stream.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["event_id"], r["accepted"]) for r in usage.anchored_windows(df, 2, 60).collect()}
    assert {(r["event_id"], r["accepted"]) for r in spark.table("verdicts").collect()} == want
    assert {r["events"] for r in limits.generation_sessions(df).collect()} == {20}


def test_ingest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("one\n\ntwo")
    (src / "b.html").write_text("<p>hi</p><script>no</script>")
    (src / "c.pdf").write_bytes(b"%PDF-1.4")
    batch = {(r["path"].rpartition("/")[2], r["content"], r["error"]) for r in ingest.chunk_files(ingest.read_files(spark, str(src))).collect()}
    assert batch == {("a.txt", "one\n\ntwo", None), ("b.html", "hi", None), ("c.pdf", None, "ValueError: a PDF without a page tree")}
    out, dead = f"{tmp_path}/chunks", f"{tmp_path}/dead"
    ingest.ingest_stream(ingest.read_files(spark, str(src), stream=True), out, dead, f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert spark.read.parquet(dead).first()["attempts"] == 1
    vectors = ingest.embed(spark.read.parquet(out).select("file_md5", "content"), lambda texts: [[float(len(t))] for t in texts])
    assert {r["vector"][0] for r in vectors.collect()} == {2.0, 8.0}


def test_token_budget_and_compound_reservation(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"2024-01-{1 + i // 8:02d} {i % 8 * 3:02d}:00:00", str(i % 3), rng.randint(0, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id string, amount long")
    budgets = ((100, 86_400), (250, 259_200), (0, 60))

    def replay(daily, budgets):
        """The counters one by one, as a store of keys with an expiry would keep them."""
        import datetime

        out, store = {}, {}
        for i, ts, user, amount in rows:
            at = datetime.datetime.fromisoformat(ts).timestamp()
            taken, fits = [], True
            for name, limit, seconds in [((user, ts[:10]), daily, None), *(((user, k), lim, sec) for k, (lim, sec) in enumerate(budgets))]:
                if limit <= 0 or (seconds is not None and seconds <= 0):
                    continue
                value, expiry = store.get(name, (0, None))
                if expiry is not None and at >= expiry:
                    value, expiry = 0, None
                value += amount
                if seconds is not None and value == amount:
                    expiry = at + seconds
                if value > limit:
                    store[name] = (value - amount, expiry)
                    fits = False
                    break
                store[name] = (value, expiry)
                taken.append(name)
            if not fits:
                for name in taken:
                    store[name] = (store[name][0] - amount, store[name][1])
            out[i] = fits
        return out

    got = {r["event_id"]: r["accepted"] for r in usage.compound_reservations(df, 80, budgets).collect()}
    assert got == replay(80, budgets) and len(set(got.values())) == 2
    got = {r["event_id"]: r["accepted"] for r in usage.token_budgets(df, 120, 172_800).collect()}
    assert got == replay(0, ((120, 172_800),)) and len(set(got.values())) == 2
    assert all(r["accepted"] for r in usage.token_budgets(df, 0, 60).collect())


def test_runtime_compaction(spark):
    rows = [(1, i, "user", f"word{i} " * 30, 100) for i in range(20)] + [(2, i, "user", "x", 1) for i in range(20)] + [(3, i, "user", "y", 4000) for i in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, tokens long")
    out = [tuple(r) for r in memory.compact_runtime(df, lambda texts: f"{len(texts)}:{texts[0].split()[0]}", least=2000, retain=12).collect()]
    assert sorted(r[:2] for r in out) == sorted([(1, 0), *((1, i) for i in range(8, 20)), *((2, i) for i in range(20)), *((3, i) for i in range(12))])
    assert [r for r in out if r[2] == "system"] == [(1, 0, "system", "[短期运行记忆摘要] 2:1:word0")]
    kept = memory.compact_runtime(df, lambda texts: " ", least=2000, retain=12).collect()
    assert sum(r["conv_id"] == 1 for r in kept) == 12 and {r["role"] for r in kept} == {"user"}


def test_empty_turns_end_a_run(spark):
    values = ["a", "a", "a", None, None, None, "a", "b", "b", "b"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, i long, v string")
    out = sorted((r["i"], r["run"], r["stagnant"]) for r in memory.runs(df, "k", "i", "v").collect())
    assert [r[1] for r in out] == [1, 2, 3, 0, 0, 0, 1, 1, 2, 3] and [r[0] for r in out if r[2]] == [2, 9]


def test_parts_are_accepted_once_and_composed(spark, tmp_path):
    parts = [(1, 0, b"a" * 10, 0), (1, 1, b"b" * 7, 1), (1, 1, b"zz", 2), (2, 0, b"c", 0), (3, 1, b"e", 0), (3, 0, b"d", 1)]
    df = spark.createDataFrame(parts, "file_id long, part int, content binary, seq long")
    new = files.accept_parts(df.where("file_id = 2"), df).collect()
    assert sorted((r["file_id"], r["part"], bytes(r["content"])) for r in new) == [(1, 0, b"a" * 10), (1, 1, b"b" * 7), (3, 0, b"d"), (3, 1, b"e")]
    first = spark.createDataFrame([tuple(r)[:2] + (bytes(r["content"]),) for r in new] + [(2, 0, b"c")], "file_id long, part int, content binary")
    expected = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "file_id long, expected long")
    out = files.merge_parts(first, expected, f"file://{tmp_path}/whole").collect()
    assert {r["file_id"]: (open(r["path"].removeprefix("file://"), "rb").read(), r["bytes"]) for r in out} == {1: (b"a" * 10 + b"b" * 7, 17), 3: (b"de", 2)}


def test_headers_and_footers_go(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "Report")
    pages = [("f", 1, "Report 1\n\nBody one\nmore\nPage 1\n"), ("f", 2, f"{wide} 2\r\nBody two\r\nReport 7\r\nlast\r\nPage 2"), ("f", 3, "Own head\nReport 3\nBody three\nPage 3"), ("f", 4, " \n"), ("g", 1, "Report 1\nalone")]
    df = spark.createDataFrame(pages, "file string, page int, text string")
    got = {(r["file"], r["page"]): r["text"] for r in files.strip_boundaries(df, "file", "page").collect()}
    assert got == {("f", 1): "Body one\nmore", ("f", 2): "Body two\nReport 7\nlast", ("f", 3): "Own head\nReport 3\nBody three", ("f", 4): "", ("g", 1): "Report 1\nalone"}


def test_token_estimate_of_odd_texts(spark):
    import math
    import unicodedata

    def plain(t):
        units = {"a": 0, "c": 0, "o": 0}
        for c in t:
            if c in " \t\n\x0b\f\r":
                continue
            if ord(c) > 0xFFFF:
                units["o"] += 2
            elif c < "\x80":
                units["a"] += 1
            else:
                name = unicodedata.name(c, "")
                units["c" if any(name.startswith(x) for x in ("CJK UNIFIED", "HIRAGANA LETTER", "KATAKANA LETTER", "HANGUL SYLL")) else "o"] += 1
        return max(1, math.ceil(units["a"] * 0.30 + units["c"] * 0.95 + units["o"] * 0.55 + 12)) if any(units.values()) else 0

    texts = ["", "  \n", "plain words", "mixed 中文 and ひらがな カタカナ 한글", "é ü ß", "😀 x", "\U00020000中", "ab" * 1000]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert [r["n"] for r in df.select(tx.estimate_tokens(df.t).alias("n")).collect()] == [plain(t) for t in texts] + [0]


def test_protected_blocks():
    found = [(b["kind"], b["start"], b["end"]) for b in chunking._protected("a\n```\n|x|\n```\n|a|b|\n|-|-|\nz\n ```open\n|t|")]
    assert found == [("CODE_BLOCK", 2, 13), ("CODE_BLOCK", 29, 40), ("TABLE_ROW", 6, 10), ("TABLE_ROW", 14, 26), ("TABLE_ROW", 37, 40)]


def test_preview_of_a_size_halfway_between_tenths(spark):
    shown = lambda n: one(spark, files.file_preview(F.lit("a.bin"), F.lit(False), F.lit(""), F.lit(n).cast("long"), F.lit("2024-01-01"))).split("\n")[1]
    assert [shown(n).split(": ")[1] for n in (1280, 1281, 1792, 1024, 1_310_720)] == ["1.2 KB", "1.3 KB", "1.8 KB", "1.0 KB", "1.2 MB"]
    assert one(spark, tx.human_size(F.lit(1280))) == "1.3 KB"  # file_sizes rounds up


def test_compatibility_form_sends_only_texts_that_it_may_change(spark):
    inert = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.match(f"[{tx.INERT}]", chr(c))]
    assert len(inert) > 30_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in inert)
    text = "".join(inert)  # in this order and the reverse no two of them compose
    assert unicodedata.normalize("NFKC", text) == text and unicodedata.normalize("NFKC", text[::-1]) == text[::-1]
    texts = ["Übergröße à l'été, 第一页 №", "plain", "e\u0301", "ＡＢ①", "가\u11a8", "1\u00a02", "Straße – Œuvre", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    assert {r["t"]: r["n"] for r in df.select("t", tx.nfkc(F.col("t")).alias("n")).collect()} == {t: t and unicodedata.normalize("NFKC", t) for t in texts}
    plain_texts = spark.createDataFrame([("Übergröße",), ("Straße – 12",)], "t string")
    plan = plain_texts.select(tx.nfkc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "normalize(CASE WHEN" in plan and [r[0] for r in plain_texts.select(tx.nfkc(F.col("t"))).collect()] == ["Übergröße", "Straße – 12"]


def test_term_line_is_the_terms(spark):
    texts = ["", " ", "...", "a", "A-b  c", "(x)", "Éte ÉTÉ, 中文。x²½", "a b c", "😀a😀 b", "İI ǅ ٣٤ _ `x{y}|~\x7fz", "Straße/[\\]^ 7:8;9@"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.term_line(F.col("t")).alias("line"), tx.terms(F.col("t")).alias("terms")).withColumn("n", tx.n_terms(F.col("line"))).collect()
    assert [(r.line, r.n) for r in rows] == [(" ".join(r.terms), len(r.terms)) for r in rows]
