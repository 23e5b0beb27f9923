"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

All stages: rows are judged one by one, also where doc_id is null or repeats; null texts count as empty ones; a stage with an
empty table gives an empty table; further columns of documents pass through all but the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, ngram_join, packing, quality
from tessera.llm.common import LOWEST, written
from tessera.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labelled ones among them, does not reject.

    Null and empty texts get the score of a text without words. Labels of documents that aren't there teach nothing. Columns named
    score or predicted are kept.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score(rows, model, threshold=0.3).where("predicted = 1").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay in another document; n_chars follows the text.

    Null texts become empty, a document that loses all its lines too. Rows that repeat a doc_id, or have none, are one document in
    the count of documents that hold a line.
    """
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row"), "doc_id", "text")
    out = line_dedup.dedup_lines(rows, min_docs=3, min_chars=20)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by Jaccard similarity of five-word shingles of 0.8 or more, the one of smallest doc_id.

    Rows are compared and dropped one by one, also where they share a doc_id or have none; null counts as the smallest id. Of
    rows with the same doc_id in a group, the one read first stays. Null and empty texts are alike nothing and all stay.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")  # numbers that hold for both readings
    groups = ngram_join.near_duplicates(rows.withColumn("doc_id", F.col("__row")), k=5, num=80, den=100)
    names = rows.select("__row", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), "__row").alias("__rank"))
    ranked = written(groups.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")).join(names, "__row"), "ranked")
    first = ranked.groupBy("__group").agg(F.min("__rank").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__group", "__first")
    gone = ranked.join(first, "__group").where("__rank <> __first").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark, each judged by its own text; null and empty texts hold none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, packed into sequences of at most 2048; an empty text is its end id."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack_sequences),
]

#: Stages 1, 3, 4 and 5 fit a model, follow links to any length, align texts and encode: not in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
