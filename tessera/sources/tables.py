"""The driver tables, and the tables of a knowledge base as they are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uploaded file for each document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5("text").alias("file_md5"),
        F.col("source").alias("file_name"),
        (F.col("doc_id") % 50).alias("user_id"),
        F.concat(F.lit("src-"), "lang").alias("org_tag"),
        (F.col("doc_id") % 10 == 0).alias("is_public"),
        F.lit(1).alias("status"),
        F.octet_length("text").cast("long").alias("total_size"),
        "text",
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """organization_tags: regions are roots, nations their children."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("tag_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_tag"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("tag_id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("parent_tag"))
    return region.union(nation)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users: org_tags is a comma-separated set of a nation and a private tag that no tag row has."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") % 100 == 0, "ADMIN").otherwise("USER").alias("role"),
        F.concat(F.lit("N"), "c_nationkey", F.lit(",PRIVATE_"), "c_custkey").alias("org_tags"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_token_record: one row for each event."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.to_date("ts").alias("record_date"),
        F.when(F.col("event_type").isin("view", "click"), "EMBEDDING").otherwise("LLM").alias("token_type"),
        F.when(F.col("event_type") == "purchase", "INCREASE").otherwise("CONSUME").alias("change_type"),
        F.floor("value").cast("long").alias("amount"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
