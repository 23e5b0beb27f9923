"""Chunking: by characters, fixed with carried overlap, and by structure."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import CHAPTER, CODE_MARK, LIST_ITEM, SECTION, TABLE_ROW, TABLE_SEPARATOR

SIZE, OVERLAP_SHARE = 512, 0.1
PARENT_CHARS = 1 << 20
SHORT = 100

# Endings that announce more, and words that continue what was said.
INCOMPLETE_ENDINGS = ("：", ":", "、", "，", ",", "（", "(")
CONTINUATION_WORDS = ("因此", "所以", "然而", "但是", "此外", "另外", "同时", "接着", "然后", "于是", "因而", "反之", "否则")

_WORD = re.compile(r"[A-Za-z0-9À-ɏ]+|\s+|.", re.S)
_SENTENCE = re.compile(r"(?<=[。！？；])|(?<=[.!?;])\s+")
_FULL_STOP = re.compile(r".*[。！？；.!?;]\s*$")
_BLANK = "".join(map(chr, range(33)))


def character_pieces(text: Column, size: int = SIZE, overlap: int = 51) -> Column:
    """Array of pieces of `size` characters, each beginning `overlap` before the last one's end; none after the end is reached."""
    step = size - overlap
    # a pattern goes through the text once, while each substr of a long text counts its characters from the start
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=(.{{1,{size}}}))(?:.{{{step}}}(?=.{{{overlap + 1}}})|.+)"), 1)


def chunk_characters(docs: DataFrame, keys: list[str], size: int = SIZE, overlap: int = 51, keep_empty: bool = False) -> DataFrame:
    """keys, chunk_id (from 1) and content. Expressions only. An empty or null text has no chunk, or, with `keep_empty`, itself as one."""
    pieces = character_pieces(F.col("text"), size, overlap)
    if keep_empty:
        pieces = F.when(F.length("text") > 0, pieces).otherwise(F.array("text"))
    return docs.select(*keys, F.posexplode(pieces).alias("p", "content")).select(*keys, (F.col("p") + 1).alias("chunk_id"), "content")


def with_overlap(chunks: DataFrame, key: str, overlap: int) -> DataFrame:
    """Each chunk but the first of its document begins with the last characters of the one before."""
    before = F.lag("content").over(Window.partitionBy(key).orderBy("chunk_id"))
    tail = F.coalesce(F.right(F.col("__before"), F.lit(overlap)), F.lit(""))
    return chunks.withColumn("__before", before).withColumn("content", F.concat(tail, "content")).drop("__before")


def words(sentence: str) -> list[str]:
    """The default segmenter: Latin words, runs of white space, single other characters."""
    return _WORD.findall(sentence)


class _Packer:
    """Appends pieces to an open chunk; closing it emits it and carries its tail into the next."""

    def __init__(self, size: int, overlap: int, tidy: bool):
        self.size, self.overlap, self.tidy, self.open, self.done = size, overlap, tidy, "", []

    def close(self, carry: bool) -> None:
        if self.open:
            self.done.append(self.open.strip(_BLANK) if self.tidy else self.open)
            self.open = self.open[-self.overlap :] if carry and 0 < self.overlap < len(self.open) else ""

    def fits(self, piece: str) -> bool:
        return len(self.open) + len(piece) <= self.size


def _sentence(text: str, size: int, overlap: int, segment: Callable[[str], list[str]]) -> list[str]:
    p = _Packer(size, overlap, tidy=False)
    for word in segment(text):
        if not p.fits(word):
            p.close(carry=True)
        p.open += word
    p.close(carry=False)
    return p.done


def _paragraph(text: str, size: int, overlap: int, segment: Callable[[str], list[str]]) -> list[str]:
    p = _Packer(size, overlap, tidy=True)
    for sentence in _java_split(_SENTENCE, text):
        if not p.fits(sentence):
            p.close(carry=True)
        if len(sentence) > size:
            p.done += _sentence(sentence, size, overlap, segment)  # a carried tail stays open and follows these pieces
        else:
            p.open += sentence
    p.close(carry=False)
    return p.done


def _java_split(pattern: re.Pattern, text: str) -> list[str]:
    """Split without empty strings at the end, nor one at the start that matched no character."""
    parts = pattern.split(text)
    while parts and not parts[-1]:
        parts.pop()
    return parts or ([text] if not text else [])


_GAP = re.compile(r"\n\n+")


def fixed_chunks(text: str, size: int = SIZE, segment: Callable[[str], list[str]] = words) -> list[str]:
    """Paragraphs packed up to `size`, long ones by sentences, long sentences by words; tails of a tenth are carried."""
    overlap = int(size * OVERLAP_SHARE)
    p = _Packer(size, overlap, tidy=True)
    for paragraph in _java_split(_GAP, text):
        if len(paragraph) > size:
            p.close(carry=False)
            p.open = ""
            p.done += _paragraph(paragraph, size, overlap, segment)
            continue
        if not p.fits(paragraph):
            p.close(carry=True)
            p.open += paragraph
        else:
            p.open += ("\n\n" if p.open else "") + paragraph
    p.close(carry=False)
    return p.done


def line_kind(line: str) -> str:
    t = line.strip(_BLANK)
    if not t:
        return "EMPTY_LINE"
    if t.startswith(CODE_MARK):
        return "CODE_BLOCK"
    for pattern, name in ((CHAPTER, "CHAPTER_HEADING"), (SECTION, "SECTION_HEADING"), (LIST_ITEM, "LIST_ITEM")):
        if re.match(pattern, t, re.A):
            return name
    if re.match(TABLE_ROW, t, re.A):
        return "TABLE_SEPARATOR" if re.match(TABLE_SEPARATOR, t, re.A) else "TABLE_ROW"
    return "PARAGRAPH"


def _first_line(text: str) -> str:
    return text.split("\n", 1)[0]


def coherent(before: str, after: str) -> bool:
    """Whether two neighbouring chunks belong together by rule."""
    a, b = before.strip(_BLANK), after.strip(_BLANK)
    if a.endswith(INCOMPLETE_ENDINGS) or b.startswith(CONTINUATION_WORDS):
        return True
    heading = line_kind(_first_line(b)) == "CHAPTER_HEADING"
    # the pattern's dot meets no line feed, so a chunk of several lines always counts as unfinished
    return not heading and (len(a) < SHORT or not _FULL_STOP.fullmatch(a))


def _by_structure(text: str, size: int) -> list[str]:
    out, open_ = [], ""

    def flush() -> None:
        nonlocal open_
        if open_:
            out.append(open_.strip(_BLANK))
        open_ = ""

    for paragraph in _java_split(_GAP, text):
        kind = line_kind(_first_line(paragraph))
        if kind in ("CHAPTER_HEADING", "SECTION_HEADING"):
            flush()
            open_ = paragraph
        elif kind in ("TABLE_ROW", "CODE_BLOCK"):
            if 0 < len(open_) < size:
                open_ += "\n\n" + paragraph
            else:
                flush()
                out.append(paragraph.strip(_BLANK))
        elif len(open_) + len(paragraph) > size * 1.5:
            flush()
            open_ = paragraph
        else:
            open_ += ("\n\n" if open_ else "") + paragraph
    flush()
    return out


def smart_chunks(text: str, size: int = SIZE, segment: Callable[[str], list[str]] = words) -> list[str]:
    """By structure; long parts as fixed_chunks(); neighbours that belong together merged; overlap put before each."""
    if not text.strip(_BLANK):
        return []
    overlap = int(size * OVERLAP_SHARE)
    parts = [p for rough in _by_structure(text, size) for p in (fixed_chunks(rough, size, segment) if len(rough) > size * 1.5 else [rough])]
    merged: list[str] = []
    for part in parts:
        if merged and (not merged[-1] or (coherent(merged[-1], part) and len(merged[-1]) + len(part) <= size * 1.2)):
            merged[-1] = f"{merged[-1]}\n\n{part}" if merged[-1] else part
        else:
            merged.append(part)
    merged = [m.strip(_BLANK) for m in merged]
    return [m if i == 0 else merged[i - 1][-overlap:] + m for i, m in enumerate(merged)]


def chunk_texts(docs: DataFrame, key: str, strategy: str = "fixed", size: int = SIZE, segment: Callable[[str], list[str]] = words, parent: int = PARENT_CHARS) -> DataFrame:
    """key, chunk_id (from 1) and content by an order-dependent strategy: one text at a time in an Arrow batch.

    Texts of more than `parent` characters are cut into blocks of that length first, which are chunked apart; ids run on. Null
    and blank texts give no chunk. Texts are not shuffled.
    """
    cut = {"fixed": fixed_chunks, "smart": smart_chunks}[strategy]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = ((k, [t[i : i + parent] for i in range(0, len(t), parent)]) for k, t in zip(b[key], b["text"], strict=True) if t and t.strip())
            rows = [(k, i, c) for k, own in blocks for i, c in enumerate((c for t in own if t.strip() for c in cut(t, size, segment)), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "content"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_id int, content string")


def parent_blocks(docs: DataFrame, keys: list[str], size: int = PARENT_CHARS) -> DataFrame:
    """keys, block (from 1) and text: texts cut into parents of `size` characters, which are chunked apart; blank-free, none for ''."""
    n = F.ceil(F.length("text") / F.lit(size)).cast("int")
    rows = docs.where(F.length("text") > 0).select(*keys, "text", F.explode(F.sequence(F.lit(1), n)).alias("block"))
    return rows.withColumn("text", F.expr(f"substring(text, (block - 1) * {size} + 1, {size})")).select(*keys, "block", "text")


def merge_similar(chunks: DataFrame, key: str, order: str, vector: str, threshold: float = 0.75) -> DataFrame:
    """chunks with `merged` (whether a chunk's vector is at least so similar to the one before it) and `block`, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    double = F.col(vector).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = chunks.withColumn("__v", double).withColumn("__p", F.lag("__v").over(w))
    cosine = F.try_divide(dot(F.col("__v"), F.col("__p")), F.sqrt(dot(F.col("__v"), F.col("__v"))) * F.sqrt(dot(F.col("__p"), F.col("__p"))))
    rows = rows.withColumn("merged", F.coalesce(cosine >= threshold, F.lit(False))).drop("__v", "__p")
    return rows.withColumn("block", F.sum(F.when(F.col("merged"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _protected(text: str | None) -> list[dict]:
    found, at, text = [], 0, text or ""
    while (start := text.find("```", at)) >= 0:
        close = text.find("```", start + 3)
        at = len(text) if close < 0 else close + 3
        found.append({"kind": "CODE_BLOCK", "start": start, "end": at})
    at, begun = 0, None
    for line in text.split("\n"):
        row = line.strip()
        if len(row) > 1 and row.startswith("|") and row.endswith("|"):
            begun = at if begun is None else begun
        elif begun is not None:
            found.append({"kind": "TABLE_ROW", "start": begun, "end": at})
            begun = None
        at += len(line) + 1
    if begun is not None:
        found.append({"kind": "TABLE_ROW", "start": begun, "end": len(text)})
    return found


def protected_blocks(text: Column) -> Column:
    """(kind, start, end) of fenced code, to the end of the text where a fence isn't closed, then of runs of table lines."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(_protected)

    return F.pandas_udf(each, "array<struct<kind:string,start:int,end:int>>")(text)
