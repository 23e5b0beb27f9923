"""Ranked lexical search: postings grouped by exact impact, processed score at a time, until bounds prove the best k."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import LOWEST, let_go, prepare, written

#: Terms are the stretches of UTF-8 bytes that this table maps to something but a blank: ASCII letters (lower-cased) and digits, and
#: everything beyond ASCII.
_TERM = bytes(b if b > 127 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Bytes of a text that are split into terms at once.
_SLICE = 1 << 20
#: Postings and documents that a task holds as one inverted block.
BLOCK_POSTINGS, BLOCK_DOCS = 1_000_000, 50_000
#: A round processes the groups whose contribution reaches this part of the largest one left.
_FALL = 0.6


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a slice at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TERM)
    at = 0
    while at < len(raw):
        end = len(raw) if at + _SLICE >= len(raw) else raw.find(b" ", at + _SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _counter(vocabulary: dict[bytes, int]):
    def count(batches):
        """doc_id, number of terms, and the queries' terms with their numbers, of each document that has a term."""
        get = vocabulary.get
        for batch in batches:
            ids, sizes, terms, times = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, Counter()
                for words in terms_of(text.as_py()):
                    n += len(words)
                    found.update(map(get, words))
                found.pop(None, None)
                if n:
                    ids.append(LOWEST if doc is None else doc)
                    sizes.append(n)
                    terms.append(list(found))
                    times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc", "n", "terms", "times"])
        let_go()

    return count


class Block:
    """The postings of some documents: by document, and by term in groups of one impact, largest first."""

    def __init__(self, doc: np.ndarray, sizes: list[int], lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, n_docs: int, all_terms: int) -> None:
        self.doc, self.term = doc, term
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        m = np.array([75 + (25 * n * n_docs) // all_terms for n in sizes], np.int64)  # Python's integers: the product may pass 64 bits
        owner = np.repeat(np.arange(len(doc)), lengths)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        order = np.lexsort((-self.impact, term))
        self.posting = owner[order]
        t, i = term[order], self.impact[order]
        edge = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])])) if len(t) else np.zeros(0, np.int64)
        self.group_impact, self.group_begin = i[edge], np.concatenate([edge, [len(t)]])
        self.groups = np.searchsorted(t[edge], np.arange(n_terms + 1))  # of each term

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents), of at most k documents: all that can be among the best k and reach floor."""
        here = self.groups[terms + 1] > self.groups[terms]
        terms, weights = terms[here], weights[here]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, end = self.groups[terms].copy(), self.groups[terms + 1]
        head = weights * self.group_impact[at]  # what a term can still add to a document's score, at most
        acc = np.zeros(len(self.doc), np.int64)
        while True:
            low = max(floor, int(np.partition(acc, len(acc) - k)[len(acc) - k]) if len(acc) >= k else 0)
            rest = int(head.sum())
            if not rest or rest < low:  # a document not met yet stays below the best k
                break
            level = max(1, math.ceil(_FALL * int(head.max())))
            for j in np.flatnonzero(head >= level):
                impacts = self.group_impact[at[j] : end[j]]
                stop = at[j] + int(np.searchsorted(-impacts, -(-(-level // int(weights[j]))), side="right"))
                p0, p1 = self.group_begin[at[j]], self.group_begin[stop]
                acc[self.posting[p0:p1]] += weights[j] * np.repeat(self.group_impact[at[j] : stop], np.diff(self.group_begin[at[j] : stop + 1]))
                at[j] = stop
                head[j] = weights[j] * self.group_impact[stop] if stop < end[j] else 0
        found = np.flatnonzero((acc > 0) & (acc + rest >= low))
        return self._whole(found, terms, weights, k)

    def _whole(self, found: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the found documents by their complete scores, from their own postings."""
        if not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = self.begin[found + 1] - self.begin[found]  # each holds a term of the query
        first = np.cumsum(lengths) - lengths
        own = np.repeat(self.begin[found] - first, lengths) + np.arange(int(lengths.sum()))
        weight = np.zeros(len(self.groups), np.int64)
        weight[terms] = weights
        score = np.add.reduceat(weight[self.term[own]] * self.impact[own], first)
        return _first(score, self.doc[found], k)


def _first(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, -score))[:k]
    return score[order], doc[order]


def _searcher(queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, all_terms: int, k: int):
    def blocks(batches):
        held, postings, docs = [], 0, 0
        for batch in batches:
            held.append(batch)
            postings, docs = postings + len(batch.column(2).flatten()), docs + len(batch)
            if postings >= BLOCK_POSTINGS or docs >= BLOCK_DOCS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, postings, docs = [], 0, 0
        if docs:
            yield pa.Table.from_batches(held).combine_chunks()

    def search(batches):
        """A task's best k documents for each query: what a block found raises the floor for the next."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for t in blocks(batches):
            lists = t.column("terms").combine_chunks()
            flat = [t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "times")]
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            block = Block(t.column("doc").to_numpy(), t.column("n").to_pylist(), lengths, *flat, n_terms, n_docs, all_terms)
            for q, (terms, weights) in enumerate(queries):
                floor = int(best[q][0][-1]) if len(best[q][0]) == k else 0
                new = block.best(terms, weights, k, floor)
                if len(new[0]):
                    best[q] = _first(*(np.concatenate(x) for x in zip(best[q], new, strict=True)), k)
        let_go()
        number = np.repeat(np.arange(len(queries)), [len(b[0]) for b in best])
        score, doc = (np.concatenate([b[i] for b in best] or [np.zeros(0, np.int64)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(doc.astype(np.int64)), pa.array(score.astype(np.int64))], ["query", "doc", "score"])

    return search


def _query_blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """Lists of (item_id, counts of its terms), with at most about block_terms different terms of an item each, summed up."""
    block, size = [], 0
    for item, text in items.select("item_id", "text").toLocalIterator():
        counts = Counter(w for words in terms_of(text) for w in words)
        if block and size + len(counts) > block_terms:
            yield block
            block, size = [], 0
        block.append((item, counts))
        size += len(counts)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of items (item_id, text), by exact impacts.

    Terms are the stretches of text without ASCII characters other than letters and digits, A-Z lower-cased. A term of weight
    w = floor(1000 ln((2N + 2) / (2 df + 1))), tf times in a document of n terms, adds w * ((10^9 tf) div (1000 tf + 12 m)) for
    each time that it stands in the item, where m = 75 + (25 n N) div L; N counts the documents with a term, L their terms.
    Equal scores are ordered by doc_id; scores of 0 aren't returned.

    One pass over the texts writes, for each document, its number of terms and its counts of the items' terms; N, L and df are sums
    over them. A second one reads these counts in blocks of about 1,000,000 postings. Each block groups its postings by exact impact
    and takes them in descending order of what they add to an item's score, round by round, until the sum of what every term can
    still add is below the k-th best score so far; the documents that can still reach it get their complete scores. A task keeps
    its best k of each item. Texts and postings aren't shuffled, only a task's best k are.

    Items are a query set: they are read in blocks of block_terms terms, and each block passes over the documents, which bounds
    what is sent to the tasks. Null texts and texts without terms match nothing and count in nothing. A null doc_id comes before
    all others; rows that repeat a doc_id are ranked each. Rows that repeat an item_id each get their ranks. Further columns are
    ignored. Without documents or items: no rows.
    """
    spark = prepare(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in _query_blocks(items, block_terms):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, counts in block for w in counts))}
        counts = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(vocabulary), "doc long, n long, terms array<int>, times array<long>"), "term-counts")
        n_docs, all_terms = counts.agg(F.count("*"), F.sum("n")).first()
        df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the block
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]
        queries = []
        for _, own in block:
            pairs = [(vocabulary[w], weight[vocabulary[w]] * c) for w, c in own.items() if weight[vocabulary[w]] > 0 and vocabulary[w] in df]
            queries.append(tuple(np.array([p[i] for p in pairs], np.int64) for i in (0, 1)))
        hits = counts.mapInArrow(_searcher(queries, len(vocabulary), n_docs, all_terms or 1, k), "query int, doc long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item_id {kind}")
        found = top.join(F.broadcast(names), "query").select("item_id", "rank", F.nullif("doc", F.lit(LOWEST)).alias("doc_id"), "score")  # names: a row for each item of the block
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
