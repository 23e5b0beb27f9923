"""Control rules on tables: rate-limit settings, invites, uploads, orders, tag assignment, queue claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.files import PART_BYTES

SINGLE = ("single_max", "single_window_seconds")
DUAL = ("minute_max", "minute_window_seconds", "day_max", "day_window_seconds")


def effective_limits(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults by config_key, overlaid by a stored row only where all fields of the default's kind are there. Unknown keys go."""
    s = stored.select("config_key", *(F.col(c).alias(f"s_{c}") for c in (*SINGLE, *DUAL)), F.lit(True).alias("has"))
    both = defaults.join(s, "config_key", "left")
    whole = lambda group: F.col("has") & F.forall(F.array(*(F.col(f"s_{c}").cast("long") for c in group)), lambda x: x.isNotNull())
    out = {}
    for group in (SINGLE, DUAL):
        for c in group:
            out[c] = F.when(F.col(c).isNotNull() & whole(group), F.col(f"s_{c}")).otherwise(F.col(c))
    return both.select("config_key", *(v.alias(k) for k, v in out.items()))


def limits_valid(day: Column, minute: Column) -> Column:
    return day >= minute


def consume_invites(requests: DataFrame, codes: DataFrame, as_of: Column) -> DataFrame:
    """Verdict of each request (request_id, code) against codes, in the order of request_id; codes are read in upper case."""
    r = requests.withColumn("code", F.upper(F.trim("code")))
    both = r.join(codes.withColumn("code", F.upper("code")).withColumn("known", F.lit(True)), "code", "left")
    usable = F.coalesce(F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)), F.lit(False))
    nth = F.sum(F.when(usable, 1).otherwise(0)).over(Window.partitionBy("code").orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0))
    verdict = (
        F.when(F.coalesce(F.length("code"), F.lit(0)) == 0, "INVITE_CODE_REQUIRED")
        .when(F.col("known").isNull() | ~F.coalesce("enabled", F.lit(False)), "INVITE_CODE_INVALID")
        .when(F.col("expires_at") <= as_of, "INVITE_CODE_EXPIRED")
        .when(F.col("used_count") + nth > F.col("max_uses"), "INVITE_CODE_EXHAUSTED")
        .otherwise("OK")
    )
    return both.select("request_id", "code", verdict.alias("verdict"))


def upload_rejected(total: Column, part: Column, part_bytes: Column, limit: Column, is_admin: Column) -> Column:
    over = (total > limit) | (part * F.lit(PART_BYTES) + part_bytes > limit)
    return ~is_admin & F.coalesce(over, F.lit(False))


def assign_tags(user_tags: Column, assigned: Column) -> Column:
    """The assigned tags, and those private ones that the user had."""
    return F.array_union(assigned, F.filter(F.split(user_tags, ","), lambda t: t.startswith("PRIVATE_")))


def assign_primary(primary: Column, tags: Column, private: Column) -> Column:
    """The primary tag as it is; where there is none, the user's private tag if it is among the tags, else the first of them."""
    first = F.when(F.array_contains(tags, private), private).otherwise(F.get(F.array_sort(tags), 0))
    return F.coalesce(F.nullif(primary, F.lit("")), first)


def credited_tokens(callbacks: DataFrame) -> DataFrame:
    """Tokens of successful orders by user; a trade number counts once, however often its success is told."""
    once = callbacks.where("status = 'SUCCEED'").dropDuplicates(["trade_no"])
    return once.groupBy("user_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("orders"))


def queue_claims(waiting: DataFrame, permits: int) -> DataFrame:
    """Which of the waiting requests (queue, request_id, since) get a permit now: the longest waiting of each queue."""
    at = F.row_number().over(Window.partitionBy("queue").orderBy("since", "request_id"))
    return waiting.withColumn("rank", at).withColumn("claimed", F.col("rank") <= permits)


def retry_deletes(pending: DataFrame, done: DataFrame, most: int = 5) -> DataFrame:
    """Pending deletes after one more round: finished ones go, others count one retry more until `most`."""
    left = pending.where(F.col("retry_count") < most).join(done, "file_md5", "left_anti")
    return left.withColumn("retry_count", F.col("retry_count") + 1)
