"""Words of scripts without spaces: learned from a corpus by how firmly characters hold together, cut out by the best path."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CJK
from tessera.operators.chunking import words as plain_words
from tessera.sources.shared import written

#: Han, kana and Hangul, for Python's patterns: the blocks that functions.text.CJK names.
UNSPACED = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿가-힯ᄀ-ᇿ\U00020000-\U0003ffff"


def learn_words(docs: DataFrame, column: str = "text", letter: str = CJK, longest: int = 4, least: int = 5, firmness: float = 20.0, most: int | None = 200_000) -> DataFrame:
    """word and n: stretches of 2 to `longest` letters that come `least` times and hold together, and all single letters.

    A stretch holds together if, wherever it is cut in two, it comes `firmness` times as often as its parts would
    by chance next to each other: n(whole) * n(letters) >= firmness * n(left) * n(right). The counts are of all stretches of all texts; counting is
    combined before the shuffle. Of the words found the `most` frequent are kept, by code point where counts are equal, which bounds
    what a segmenter sends to the tasks; None keeps all. Null texts have no words. Equal runs of letters are counted first and cut
    into stretches once, so words that come often cost little.
    """
    run = F.regexp_extract_all(F.col(column), F.lit(f"({letter}+)"), 1)
    runs = docs.select(F.explode(run).alias("r")).groupBy("r").agg(F.count("*").alias("c"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(F.length("r") >= k, F.transform(F.sequence(F.lit(1), F.length("r") - k + 1), lambda i: F.substring("r", i, k))).otherwise(F.array().cast("array<string>"))))
    n = written(runs.select("c", F.explode(grams).alias("word")).groupBy("word").agg(F.sum("c").alias("n")), "grams")
    total = float(n.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    cuts = n.where((F.length("word") > 1) & (F.col("n") >= least)).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    halves = cuts.select("word", "n", F.expr("substring(word, 1, i)").alias("left"), F.expr("substring(word, i + 1)").alias("right"))
    left, right = n.select(F.col("word").alias("left"), F.col("n").alias("nl")), n.select(F.col("word").alias("right"), F.col("n").alias("nr"))
    firm = halves.join(left, "left").join(right, "right").groupBy("word", "n").agg(F.min(F.col("n") * F.lit(total) / (F.col("nl").cast("double") * F.col("nr"))).alias("hold")).where(F.col("hold") >= firmness)
    found = firm.select("word", "n").union(n.where(F.length("word") == 1))
    return found if most is None else found.orderBy(F.desc("n"), "word").limit(most)


class Lattice:
    """The likeliest words of a stretch: all words of the dictionary that begin at a place, found along a trie, are edges of a lattice;
    a letter that no word holds is an edge of its own. Costs are negative log frequencies, of equal paths the one of longer first words."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) + 1
        self.unknown = math.log(total) + 10.0
        self.root: dict = {}
        for word, n in counts.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = math.log(total) - math.log(n)

    def edges(self, text: str, at: int) -> list[tuple[int, float]]:
        """(end, cost) of the words that begin at `at`."""
        node, out = self.root, []
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                out.append((end + 1, node[""]))
        if not out or out[0][0] != at + 1:
            out.append((at + 1, self.unknown))
        return out

    def words(self, text: str) -> list[str]:
        cost, step = [math.inf] * len(text) + [0.0], [0] * len(text)
        for at in range(len(text) - 1, -1, -1):
            for end, c in self.edges(text, at):
                if (c + cost[end], -end) < (cost[at], -step[at]):
                    cost[at], step[at] = c + cost[end], end
        out, at = [], 0
        while at < len(text):
            out.append(text[at : step[at]])
            at = step[at]
        return out


def segmenter(counts: dict[str, int], unspaced: str = UNSPACED) -> Callable[[str], list[str]]:
    """A function for chunking's `segment`: stretches of the script by the lattice, the rest as chunking does; joined, its pieces are the text."""
    lattice, parts = Lattice(counts), re.compile(f"[{unspaced}]+|[^{unspaced}]+")

    def segment(text: str) -> list[str]:
        out = []
        for p in parts.findall(text):
            out += lattice.words(p) if re.match(f"[{unspaced}]", p) else plain_words(p)
        return out

    return segment


def learned_segmenter(words: DataFrame, unspaced: str = UNSPACED) -> Callable[[str], list[str]]:
    """The segmenter of learn_words' table, which its `most` bounds."""
    return segmenter({r["word"]: r["n"] for r in words.collect()}, unspaced)
