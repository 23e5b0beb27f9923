"""Rules that only show in cases of their own: fallbacks, parents, entries, messages, primary tags."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import chunking, control, memory, retrieval, usage
from tessera.plans import lifecycle


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_searches_fall_back_and_end_empty(spark):
    def broken():
        return spark.range(3).select(F.raise_error(F.lit("index gone")).alias("rank"))

    good = lambda: spark.range(2).select(F.col("id").cast("int").alias("rank"))
    assert retrieval.with_fallbacks(spark, [broken, good], "rank int").count() == 2
    last = retrieval.with_fallbacks(spark, [broken, broken], "rank int, bm25 double")
    assert last.count() == 0 and last.columns == ["rank", "bm25"]


def test_a_failed_search_is_no_empty_result(spark, tmp_path):
    with pytest.raises(Exception, match="documents"):  # no such table
        lifecycle.hybrid_search_fallback(spark, str(tmp_path)).collect()
    (tmp_path / "documents.parquet").write_text("torn")
    with pytest.raises(Exception, match="documents|[Pp]arquet"):
        lifecycle.hybrid_search_fallback(spark, str(tmp_path)).collect()

    def unreachable():
        raise ConnectionError("no model")

    def mistaken():
        raise KeyError("embedding")

    good = lambda: spark.range(2).select(F.col("id").cast("int").alias("rank"))
    assert retrieval.with_fallbacks(spark, [unreachable, good], outages=ConnectionError).count() == 2
    with pytest.raises(KeyError):
        retrieval.with_fallbacks(spark, [mistaken, good], outages=ConnectionError)
    with pytest.raises(RuntimeError, match="all of 2 searches failed: no model; no model"):
        retrieval.with_fallbacks(spark, [unreachable, unreachable])


def test_parents_are_chunked_apart_with_running_ids(spark):
    text = " ".join(f"Sentence number {i}." for i in range(120))
    got = chunking.chunk_texts(spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "x" + " " * 990 + "y")], "doc_id long, text string"), "doc_id", "fixed", 100, parent=500).collect()
    want = [c for i in range(0, len(text), 500) for c in chunking.fixed_chunks(text[i : i + 500], 100)]
    assert [(r["chunk_id"], r["content"]) for r in got if r["doc_id"] == 1] == list(enumerate(want, 1))
    assert [r["chunk_id"] for r in got if r["doc_id"] == 2] == [1] and not [r for r in got if r["doc_id"] == 3]


def test_messages_entries_and_primary_tags(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, memory.whole_message_tokens(s("user"), s("abcd"), s(None), s(None), s(None))) == 8 + 14 + 14
    assert one(spark, memory.whole_message_tokens(s("user"), s("abcd"), s("abcd"), s("{broken"), s("abcd"))) == 8 + 14 * 4 + 128
    assert one(spark, memory.tool_tokens(s("abcd"), s("abcd"), s("{}"))) == 14 + 14 + 13
    assert one(spark, memory.tool_tokens(s(None), s(""), s("["))) == 80
    assert one(spark, memory.limited_entry(s("tool"), s(" a  b\n" + "c" * 900))) == "a b " + "c" * 796 + "...(已截断)"
    assert one(spark, memory.limited_entry(s("user"), s(None))) == ""
    tags = F.array(F.lit("b"), F.lit("a"), F.lit("PRIVATE_u"))
    assert one(spark, control.assign_primary(s(""), tags, s("PRIVATE_u"))) == "PRIVATE_u"
    assert one(spark, control.assign_primary(s(None), tags, s("PRIVATE_x"))) == "PRIVATE_u"
    assert one(spark, control.assign_primary(s("kept"), tags, s("PRIVATE_u"))) == "kept"
    assert one(spark, control.assign_primary(s(None), F.array().cast("array<string>"), s("x"))) is None


def test_discounts_days_and_switched_off_alerts(spark):
    assert [one(spark, values.discount_to_percent(F.lit(x).cast("string"))) for x in ("8.5", "10", "0.05", " ", None)] == [85, 100, 0, None, None]
    assert [one(spark, values.percent_to_discount(F.lit(x))) for x in (85, 100)] == ["8.5", "10.0"]
    assert [one(spark, values.legal_price(F.lit(x).cast("string"))) for x in ("1.00", "0", "", None)] == [True, False, False, False]
    at = F.lit("2024-02-28 23:59:59.5").cast("timestamp")
    assert one(spark, values.seconds_to_day_end(at)) == 1 and one(spark, values.retention_seconds(at, 0)) == 86_400
    assert one(spark, values.seconds_to_day_end(F.lit("2024-02-28 00:00:00").cast("timestamp"))) == 86_400
    level = lambda on: usage.alert_level(F.lit(9), F.lit(9), F.lit(0), on)
    assert [one(spark, level(x)) for x in (None, F.lit(True), F.lit(False), F.lit(None).cast("boolean"))] == ["critical", "critical", None, None]
