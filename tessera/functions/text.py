"""Text functions as Column expressions: tokens, token estimates, truncation, line types, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the token estimate: weight of an ASCII, a CJK and any other character, and the overhead of a text.
ASCII_WEIGHT, CJK_WEIGHT, OTHER_WEIGHT, OVERHEAD = 0.30, 0.95, 0.55, 12
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

# Fixed patterns of line types, first match wins.
CODE_MARK = "```"
CHAPTER = r"^\s*(?:第[一二三四五六七八九十百]+[章篇节]|Chapter\s+\d+|CHAPTER\s+\d+|\d+\.\s+.*).*$"
SECTION = r"^\s*\d+\.\d+(?:\.\d+)?\s+.*$"
LIST_ITEM = r"^\s*(?:[-*•]|\d+[.、])\s+.*$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_SEPARATOR = r"^\s*\|[\s:-]+\|.*$"

# Fixed patterns: ends of sentences, for splitting and for evidence.
SENTENCE_END = r"(?<=[。！？；])|(?<=[.!?;])\s+"
EVIDENCE_END = r"(?<=[。！？!?；;])"

# Fixed values of explicit memories: the prefix that asks for one, and the words of a preference.
MEMORY_PREFIX = r"(?is)^(?:请)?(?:帮我)?记住[：:,，\s]*(.+)$"
PREFERENCE_WORDS = ("喜欢", "偏好", "习惯", "以后", "默认")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def term_line(text: Column) -> Column:
    """The terms of a text, joined by a space: for where a list of so many strings costs more than their work."""
    low = F.lower(text)
    gaps = F.when(F.octet_length(low) == F.length(low), r"[\x00-/:-`{-\x7F]+").otherwise(r"[\x00-/:-`{-\x7F[^\x00-\x7F\p{L}\p{N}]]+")
    return F.trim(F.regexp_replace(low, gaps, F.lit(" ")))


def n_terms(line: Column) -> Column:
    """How many terms a term_line has."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens of a text; 0 for blank or null. Characters outside the basic plane count as two others.

    Only the characters beyond ASCII are looked at by pattern, and none in a text of as many bytes as characters.
    """
    t = F.coalesce(text, F.lit(""))
    solid = F.length(F.translate(t, " \t\n\x0b\f\r", ""))
    beyond = F.when(F.octet_length(t) == F.length(t), "").otherwise(F.regexp_replace(t, r"[\x00-\x7F]+", ""))
    left = lambda x, pattern: F.length(F.regexp_replace(x, pattern, ""))

    def value(x: Column) -> Column:
        b, n = x["beyond"], F.length(x["beyond"])
        wide = n - left(b, r"[\x{10000}-\x{10FFFF}]+")
        far = F.regexp_replace(b, r"[^\x{10000}-\x{10FFFF}]+", "")
        wide_cjk = F.when(wide == 0, 0).otherwise(F.length(far) - left(far, f"{CJK}+"))
        narrow_cjk = n - left(b, f"{CJK}+") - wide_cjk
        plain = x["solid"] - n
        other = n - narrow_cjk + wide
        total = plain * F.lit(ASCII_WEIGHT) + narrow_cjk * F.lit(CJK_WEIGHT) + other * F.lit(OTHER_WEIGHT) + F.lit(float(OVERHEAD))
        return F.when(x["solid"] == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(total))).cast("long")

    return F.get(F.transform(F.array(F.struct(solid.alias("solid"), beyond.alias("beyond"))), value), 0)


def estimate_embedding_tokens(total_with_overhead: Column) -> Column:
    """From the sum over texts of (tokens + 4)."""
    return F.ceil(F.coalesce(total_with_overhead, F.lit(0)) * F.lit(1.15)).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, limit: int, suffix: str) -> Column:
    """At most `limit` characters, followed by the suffix where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def anchor_text(text: Column, limit: int = 120) -> Column:
    """Collapsed text of at most `limit` characters; null if blank."""
    t = collapse(text)
    return F.when(F.length(t) > 0, truncate(t, limit, "…"))


def line_type(line: Column) -> Column:
    t = F.trim(line)
    kinds = F.when(line.isNull() | (F.length(F.regexp_replace(line, r"\s", "")) == 0), "EMPTY_LINE").when(t.startswith(CODE_MARK), "CODE_BLOCK")
    for pattern, name in ((CHAPTER, "CHAPTER_HEADING"), (SECTION, "SECTION_HEADING"), (LIST_ITEM, "LIST_ITEM")):
        kinds = kinds.when(t.rlike(pattern), name)
    table = F.when(t.rlike(TABLE_SEPARATOR), "TABLE_SEPARATOR").otherwise("TABLE_ROW")
    return kinds.when(t.rlike(TABLE_ROW), table).otherwise("PARAGRAPH")


def sentences(text: Column) -> Column:
    """Split after sentence ends; empty pieces at the end are dropped."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: F.length(s) > 0)


def evidence_snippet(anchor: Column, chunk: Column, limit: int = 160) -> Column:
    """The anchor if there is one, else the first sentence of at least 12 characters, else the chunk; cut to the limit."""
    long_ones = F.filter(F.transform(F.split(chunk, EVIDENCE_END, -1), lambda s: F.trim(s)), lambda s: F.length(s) >= 12)
    best = F.when(F.length(F.trim(F.coalesce(anchor, F.lit("")))) > 0, anchor).otherwise(F.coalesce(F.get(long_ones, 0), chunk))
    return truncate(collapse(best), limit, "…")


def memory_tokens(text: Column) -> Column:
    """Distinct ASCII words of two characters or more, CJK characters and pairs of neighbouring ones."""
    t = F.lower(text)
    words = F.regexp_extract_all(t, F.lit(r"([a-z0-9_-]{2,})"), 1)
    runs = F.regexp_extract_all(t, F.lit(rf"({CJK}+)"), 1)
    single = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda c: F.length(c) > 0)))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(words, single, pairs))


def boundary_key(line: Column) -> Column:
    """The key by which repeated page headers and footers are found; the line is in Unicode compatibility form (see `nfkc`)."""
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, " ", " "), r"\s+", " "), r"\d+", "#")))
    return F.when(F.length(key).between(4, 120), key)


#: Characters that compatibility form leaves as they are whatever stands beside them, if that is one of them too.
INERT = r"\x00-\x7F¡§©«®°±¶·»¿À-ıĴ-ľŁ-ňŊ-žΑ-ΡΣ-ώЀ-ҁҊ-ӿ‐‒-―‘-„†-•、-〩ぁ-ゖァ-ヺー一-鿿가-힣"


def nfkc(text: Column) -> Column:
    """Unicode compatibility form, which Spark has no function for. Only texts that it may change are sent to Python."""

    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")  # a class of many ranges is slow, so it sees few characters
    may = (F.octet_length(text) > F.length(text)) & beyond.rlike(f"[^{INERT}]")
    return F.when(may, F.pandas_udf(normalize, "string")(F.when(may, text))).otherwise(text)


def tag_slug(name: Column) -> Column:
    """ORG_ and the name in lower case with runs of other characters as one dash; 'tag' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(F.concat(F.lit("ORG_"), F.when(F.length(s) > 0, s).otherwise("tag")), 1, 255)


def unique_slugs(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with tag_id: the slug, and from the second row with a slug on _2, _3 and so on behind it."""
    slugs = rows.withColumn("__slug", tag_slug(F.col(name)))
    at = F.row_number().over(Window.partitionBy("__slug").orderBy(order))
    return slugs.withColumn("__at", at).withColumn("tag_id", F.when(F.col("__at") == 1, F.col("__slug")).otherwise(F.concat(F.expr("substring(__slug, 1, 250)"), F.lit("_"), F.col("__at")))).drop("__slug", "__at")


def explicit_memory(message: Column) -> Column:
    """What a message asks to remember, of 4 to 1000 characters; else null."""
    content = collapse(F.regexp_extract(F.trim(message), MEMORY_PREFIX, 1))
    return F.when(F.length(content).between(4, 1000), content)


def memory_type(content: Column) -> Column:
    liked = F.lit(False)
    for word in PREFERENCE_WORDS:
        liked = liked | F.lower(F.coalesce(content, F.lit(""))).contains(word)
    return F.when(liked, "PREFERENCE").otherwise("FACT")


def stream_payloads(chunk: Column) -> Column:
    """Payloads of an event-stream chunk: its lines without blank ones, comments and the data: prefix; the whole chunk if none is left."""
    whole = F.btrim(chunk, F.lit(" \t\r\n"))
    lines = F.filter(F.transform(F.split(whole, r"\r?\n", -1), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~x.startswith(":"))
    bare = F.filter(F.transform(lines, lambda x: F.when(x.startswith("data:"), F.trim(F.substring(x, 6, 1 << 30))).otherwise(x)), lambda x: F.length(x) > 0)
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).when(F.size(bare) == 0, F.array(whole)).otherwise(bare)


def human_size(size: Column, half_even: bool = False) -> Column:
    """Bytes in the largest fitting unit, to one decimal; what lies halfway (1280 bytes) is rounded up, with `half_even` as C's printf does."""
    kb = 1024.0
    tenths = (lambda x: F.bround(x, 1)) if half_even else (lambda x: x)
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.format_string("%.1f KB", tenths(size / kb)))
        .when(size < 1024**3, F.format_string("%.1f MB", tenths(size / kb**2)))
        .otherwise(F.format_string("%.1f GB", tenths(size / kb**3)))
    )
