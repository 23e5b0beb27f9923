"""Language ID by compression: the language whose dictionary shortens a text most, unless the margin is narrow."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """What is compressed of a text: its runs of letters, lower-cased, with one space around each; of a word that follows
    itself, once. So case, marks and stuttering don't outweigh the language."""
    words = _WORD.findall(text.lower())
    kept = [w for w, before in zip(words, ["", *words], strict=False) if w != before]
    return f" {' '.join(kept)} ".encode()


@dataclass(frozen=True)
class Languages:
    """Raw-content dictionaries by language, the most frequent language first. The shorter ones are filled up in front with zero
    bytes, which no plain text holds and no compressor is given."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int
    chunk: int


def learn(docs: DataFrame, docs_each: int = 2000, chars_each: int = 600, level: int = 6, chunk: int = 4096) -> Languages:
    """Dictionaries from docs (text, lang): for each lang, up to chars_each characters of each of about docs_each texts.

    docs_each * chars_each bounds what reaches the driver for a language; the texts taken are those of smallest hash, equal
    texts once, and of a longer text a piece that begins where its hash says. Every language keeps all its bytes, however few
    another one has. Rows with null text or lang, and languages without a letter, teach nothing. The languages themselves are
    counted over all rows.
    """
    begin = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - chars_each + 1, F.lit(1))).cast("int") + 1
    rows = docs.where("text is not null and lang is not null and length(text) > 0").select("lang", F.xxhash64("text").alias("h"), F.substring("text", begin, F.lit(chars_each)).alias("t"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    limit = F.lit(0.0)
    for name, n in counts.items():
        limit = F.when(F.col("lang") == name, F.lit(min(1.0, 1.2 * docs_each / max(1, n)))).otherwise(limit)
    some = rows.where(F.pmod("h", F.lit(1_000_003)) < limit * 1_000_003).dropDuplicates(["lang", "h"]).toPandas().sort_values(["lang", "h"])
    texts = {k: b"".join(map(plain, g["t"][:docs_each])) for k, g in some.groupby("lang") if any(map(has_letter, g["t"][:docs_each]))}
    names = tuple(sorted(texts, key=lambda k: (-counts[k], k)))
    size = max(map(len, texts.values()), default=0)
    return Languages(names, tuple(texts[n].rjust(size, b"\0") for n in names), level, chunk)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Judge:
    """Compressors of a model, made once a task: looking them up by the model would compare whole dictionaries at each call."""

    def __init__(self, model: Languages):
        self.model = model
        lengths = [len(d.lstrip(b"\0")) for d in model.dictionaries]
        #: For each language, t such that its dictionary has about 1 / 4**t of the largest one's bytes, up to a factor of 2.
        self.tiers = [round(math.log(max(lengths) / n, 4)) for n in lengths]
        self.order = sorted(range(len(lengths)), key=lambda n: (self.tiers[n], n))
        self.compressors = {(n, tier): self._compressor(n, tier) for tier in set(self.tiers) for n, t in enumerate(self.tiers) if t <= tier}

    def _compressor(self, language: int, tier: int):
        """With the language's dictionary, cut to the bytes of the tier if it is larger."""
        import zstandard

        whole = self.model.dictionaries[language]
        raw = whole.lstrip(b"\0")
        if self.tiers[language] < tier:
            raw = raw[-max(1, len(whole) >> (2 * tier)) :]
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=self.model.level)
        return zstandard.ZstdCompressor(level=self.model.level, dict_data=d, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> dict[tuple[int, int], float]:
        """By language and tier, compressed bytes of the whole plain text with the dictionary cut to that tier. Long texts are
        compressed in chunks, so that every part meets the dictionary and not only the text before it."""
        raw, chunk = plain(text), self.model.chunk
        pieces = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
        return {key: float(sum(len(c.compress(p)) for p in pieces)) for key, c in self.compressors.items()}

    def advantage(self, found: dict[tuple[int, int], float], a: int, b: int) -> float:
        """By what share of a's size b's is larger (negative: smaller). The language with the larger dictionary counts with the
        geometric mean of its sizes with the whole dictionary and with one cut to the other's bytes: neither does the mere
        amount of text decide against a rare language, nor the noise of a few bytes against a frequent one."""
        low = max(self.tiers[a], self.tiers[b])
        x, y = (found[n, self.tiers[n]] * found[n, low] for n in (a, b))
        return math.sqrt(y / x) - 1

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language and by what share of its size the second smallest is larger; see identify()."""
        names = self.model.names
        if not text or not names or not has_letter(text):
            return UNKNOWN, 0.0
        if len(names) == 1:
            return names[0], math.inf
        s, best = self.sizes(text), self.order[0]
        for n in self.order[1:]:
            if self.advantage(s, best, n) < 0:
                best = n
        return names[best], max(0.0, min(self.advantage(s, best, n) for n in self.order if n != best))


def identify(docs: DataFrame, model: Languages, margin: float = 0.01) -> DataFrame:
    """All columns of docs plus lang_pred, score and accepted.

    lang_pred: the language whose dictionary gives the fewest bytes over the whole text (ties: the one learned from more texts); 'und' if
    the text is null or has no letter, or nothing was learned. Languages are compared in pairs, those of the larger dictionaries
    first, the better one with the next (`advantage`). score, 0 to 1: how far the second smallest lies above the
    smallest, as a share of it (not below 0), squashed by x / (x + 0.05); 0 for 'und', 1 if one language was learned. accepted: the share is
    at least `margin` (false for 'und'); callers who want rejection read lang_pred where accepted is true.

    Rows are judged one by one: repeated rows and rows with a null doc_id are judged like any other, and neither doc_id nor any column
    but text is read. An empty table gives an empty table.

    One text at a time is encoded, in chunks, so very long texts need no more memory. Input columns of the new names are
    replaced. No shuffle.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        for texts in batches:
            rows = []
            for t in texts:
                lang, x = judge.judge(t)
                score = 1.0 if x == math.inf else x / (x + 0.05)
                rows.append((lang, float(score), bool(x >= margin and lang != UNKNOWN)))
            yield pd.DataFrame(rows, columns=["lang", "score", "accepted"])

    out = docs.withColumn("__p", predict("text"))
    return out.withColumns({"lang_pred": F.col("__p.lang"), "score": F.col("__p.score"), "accepted": F.col("__p.accepted")}).drop("__p")
