"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features, fitting one shallow tree on one feature's bins at a time, so each feature ends as a lookup
table from bin to log-odds; then the pairs of features that explain most of what is left get tables of their own. A score is
the sum of table entries.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare

FEATURES = (
    "log_words", "log_chars", "mean_word", "long_words", "distinct_words", "top_word", "repeated_neighbours", "letters", "upper", "digits",
    "marks", "symbols", "spaces", "non_ascii", "lines_per_word", "distinct_lines", "short_lines", "line_ends", "pipes", "word_marks", "entropy",
    "upper_words", "urls", "sentence_length",
)
_SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]\\^~=+@/_]")
_MARKS = re.compile(r"[.,;:!?]")
_MARK_END = re.compile(r"[^\w\s.,;:?'\"()-]+(?=\s|$)|!!+")
_END = re.compile(r"[.!?](?=\s|$)")


def features(text: str | None) -> list[float]:
    """Numbers that describe the whole text; all 0 without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, c = len(words), len(text)
    counts, chars = Counter(words), Counter(text)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(v for k, v in chars.items() if k.isalpha())
    p = np.fromiter(chars.values(), float) / c
    return [
        np.log1p(n),
        np.log1p(c),
        c / n,
        sum(v for k, v in counts.items() if len(k) > 14) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        letters / c,
        sum(v for k, v in chars.items() if k.isupper()) / max(1, letters),
        sum(v for k, v in chars.items() if k.isdigit()) / c,
        len(_MARKS.findall(text)) / n,
        len(_SYMBOLS.findall(text)) / n,
        (chars[" "] + chars["\n"]) / c,
        sum(v for k, v in chars.items() if k > "\x7f") / c,
        len(lines) / n,
        len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
        chars["|"] / n,
        len(_MARK_END.findall(text)) / n,
        float(-(p * np.log(p)).sum()),
        sum(v for k, v in counts.items() if len(k) > 1 and k.isupper()) / n,
        (text.count("http") + text.count("@")) / n,
        np.log1p(n / max(1, len(_END.findall(text)))),
    ]


@dataclass(frozen=True)
class Model:
    """Bin edges and lookup tables by feature; pairs: (i, j, edges of i, edges of j, table)."""

    base: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray, np.ndarray, np.ndarray], ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, a, b, t in self.pairs:
            out += t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    if not len(x):
        return x
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))
    return q[q > x.min()]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """The value of each bin under a tree that splits the bins `leaves` - 1 times where the gain is largest."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]

    def best(a: int, z: int) -> tuple[float, int]:
        k = np.arange(a + 1, z)
        if not len(k):
            return 0.0, a
        lg, lh, rg, rh = cg[k] - cg[a], ch[k] - ch[a], cg[z] - cg[k], ch[z] - ch[k]
        gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (cg[z] - cg[a]) ** 2 / (ch[z] - ch[a] + ridge)
        gain = np.where((lh >= least) & (rh >= least), gain, 0)
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    for _ in range(leaves - 1):
        gain, cut, where = max((*best(a, z), i) for i, (a, z) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, z = parts[where]
        parts[where : where + 1] = [(a, cut), (cut, z)]
    out = np.empty(len(g))
    for a, z in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + ridge)
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, pairs: int = 8, pair_bins: int = 8, leaves: int = 3) -> Model:
    """Fit the model on features x and labels y (0 or 1)."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    edges = [_quantiles(x[:, j], bins) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds if len(y) else 0):
        for j, e in enumerate(edges):
            if len(e):
                g, h = slope()
                step = rate * _tree(np.bincount(at[j], g, len(e) + 1), np.bincount(at[j], h, len(e) + 1), leaves, 1.0, 0.05)
                tables[j] += step
                f += step[at[j]]
    coarse = [_quantiles(x[:, j], pair_bins) for j in range(x.shape[1])]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    g, h = slope()
    gains = []
    for i, j in combinations([j for j, e in enumerate(coarse) if len(e)], 2):
        k = low[i] * (len(coarse[j]) + 1) + low[j]
        a, b = np.bincount(k, g), np.bincount(k, h)
        gains.append((float((a**2 / (b + 5)).sum()), i, j))
    chosen = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(rounds // 4 if len(y) else 0):
        for i, j, a, b, t in chosen:
            g, h = slope()
            k = low[i] * t.shape[1] + low[j]
            step = rate * np.bincount(k, g, t.size) / (np.bincount(k, h, t.size) + 5.0)
            t += step.reshape(t.shape)
            f += step[k]
    return Model(base, tuple(edges), tuple(tables), tuple(chosen))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model:
    """Fit on docs (doc_id, text) joined with labels (doc_id, quality).

    At most about `sample` labelled documents are used, those of smallest hash of doc_id, so what is broadcast (their
    labels) and what reaches the driver (their features) is bounded. Labels other than 0 and 1 and null labels teach nothing; of
    labels that repeat a doc_id the largest counts. Documents with a null doc_id have no label; rows that repeat a doc_id each teach.
    Without a labelled document every score is 0.5.
    """
    prepare(docs.sparkSession)
    rows = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").alias("quality"))
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    numbers = _numbers()
    got = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", numbers("text").alias("x"), "quality").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return boost(x, got["quality"].to_numpy(float))


def _numbers():
    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return numbers


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of docs plus score (0 to 1, higher: quality 1 likelier) and predicted (1 if score >= threshold, else 0).

    The whole text counts, whatever its length. Null and empty texts have all features 0 and get the score of that point.
    Rows are judged one by one, repeated ones and those with a null doc_id like any other; an empty table gives an empty table.
    Labels, lang, source and doc_id are not read. Columns named score or predicted are replaced. No shuffle.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def add_up(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return docs.withColumn("score", add_up("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
