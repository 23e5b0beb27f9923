"""Hybrid retrieval: BM25, exact cosine neighbours, reciprocal rank fusion, permission filter."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import terms

log = logging.getLogger(__name__)

K1, B = 1.2, 0.75
RRF_K = 60
CHUNK = ["doc_id", "chunk_id"]


def ranked(hits: DataFrame, score: str, keys: list[str], n: int) -> DataFrame:
    """The n best rows with rank 1..n: score (to 9 places) descending, then keys. Only n rows meet in one task."""
    top = hits.withColumn("__s", F.round(score, 9)).orderBy(F.desc("__s"), *keys).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__s"), *keys))).drop("__s")


def postings(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """term, keys, tf and dl: the inverted index as a table."""
    t = chunks.select(*keys, terms(F.col("content")).alias("terms")).withColumn("dl", F.size("terms"))
    return t.select(*keys, "dl", F.explode("terms").alias("term")).groupBy("term", *keys, "dl").agg(F.count("*").alias("tf"))


def _times(terms_: str, term: str) -> Column:
    return F.size(F.filter(terms_, lambda x: x == term))


def bm25(chunks: DataFrame, query: list[str], keys: list[str], allowed: Column | None = None) -> DataFrame:
    """keys and bm25 of the allowed chunks that hold a query term; statistics are those of all chunks.

    One pass counts chunks, lengths and, for each query term, the chunks that hold it; its single row then meets
    the second pass, which takes only texts apart that hold the letters of a query term. Neither builds postings of terms that
    aren't asked for, and nothing but counts is shuffled.
    """
    query = sorted(set(query))

    def count(df: DataFrame) -> DataFrame:
        return df.withColumn("__t", terms(F.col("content"))).withColumns({f"__tf{i}": _times("__t", q) for i, q in enumerate(query)}).withColumn("__dl", F.size("__t"))

    holds = F.lit(False)
    for q in query:
        holds = holds | F.lower("content").contains(q)
    stats = count(chunks).agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(query))))
    rows = count(chunks.where(holds))
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(stats.withColumn("__one", F.lit(1))), "__one")
    parts = []
    for i in range(len(query)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        parts.append(idf * tf / (tf + K1 * (1 - B + B * F.col("__dl") / F.col("__avg"))))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    # a term that is held always adds something; asked after the join, so that Spark doesn't split the text for each term again
    return rows.select(*keys, total.alias("bm25")).where("bm25 > 0")


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*map(F.lit, map(float, query)))
    v = vector.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm * F.lit(sum(x * x for x in map(float, query)) ** 0.5))


def knn(vectors: DataFrame, query: list[float], keys: list[str], k: int) -> DataFrame:
    """The k nearest by exact cosine, with rank."""
    return ranked(vectors.select(*keys, cosine(F.col("embedding"), query).alias("cosine")), "cosine", keys, k)


def fuse(lexical: DataFrame, semantic: DataFrame | None, keys: list[str], n: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists with rank: keys, bm25_rank, knn_rank, score and rank of the n best."""
    a = lexical.select(*keys, F.col("rank").alias("bm25_rank"))
    if semantic is None:
        both = a.withColumn("knn_rank", F.lit(None).cast("int"))
    else:
        both = a.join(semantic.select(*keys, F.col("rank").alias("knn_rank")), keys, "full_outer")
    part = {c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("bm25_rank", "knn_rank")}
    order = [F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("knn_rank"), *keys]
    top = both.withColumn("score", F.round(part["bm25_rank"] + part["knn_rank"], 9)).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rescore(candidates: DataFrame, scores: DataFrame, keys: list[str], n: int, query_weight: float = 0.2, rescore_weight: float = 1.0) -> DataFrame:
    """query_weight * cosine + rescore_weight * bm25 over a window of neighbours."""
    both = candidates.join(scores, keys, "left").withColumn("score", query_weight * F.col("cosine") + rescore_weight * F.coalesce("bm25", F.lit(0.0)))
    return ranked(both.select(*keys, "score"), "score", keys, n)


def with_fallbacks(spark: SparkSession, arms: list, schema: str | None = None, outages: type[Exception] | tuple = Exception) -> DataFrame:
    """The rows of the first arm that comes through. An arm is a function that gives a short ranked list.

    Only a failure among `outages` leads to the next arm, any other is raised. Where all arms fail, that is raised too: no rows would
    look like a search that found nothing. A caller who wants an empty list then, as the reference's service gives, names its `schema`.
    """
    failed = []
    for arm in arms:
        try:
            hits = arm()
            return spark.createDataFrame(hits.collect(), hits.schema)
        except outages as e:
            log.warning("a search failed, the next one is tried: %s", e)
            failed.append(e)
    if schema is None:
        raise RuntimeError(f"all of {len(failed)} searches failed: {'; '.join(map(str, failed))}") from (failed[-1] if failed else None)
    log.error("all of %d searches failed, an empty list is given", len(failed))
    return spark.createDataFrame([], schema)
