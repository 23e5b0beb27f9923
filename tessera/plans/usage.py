"""Usage, order and JSON queries: name -> (query, SQL of the same rows or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import files, memory, usage
from tessera.sources import tables
from tessera.sources.tables import table

LIMIT = 60
LEDGER_SQL = """SELECT event_id, ts, user_id::VARCHAR AS user_id, ts::DATE AS record_date,
  CASE WHEN event_type IN ('view', 'click') THEN 'EMBEDDING' ELSE 'LLM' END AS token_type,
  CASE WHEN event_type = 'purchase' THEN 'INCREASE' ELSE 'CONSUME' END AS change_type, floor(value)::BIGINT AS amount FROM events"""
BALANCE_SQL = f"""SELECT *, balance_after - change AS balance_before FROM (SELECT *, CASE WHEN change_type = 'INCREASE' THEN amount ELSE -amount END AS change,
  10000 + sum(CASE WHEN change_type = 'INCREASE' THEN amount ELSE -amount END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS balance_after FROM ({LEDGER_SQL}))"""
DAILY_SQL = f"""SELECT user_id, record_date, token_type, sum(amount)::BIGINT AS amount, count(*) AS requests, arg_min(balance_before, event_id)::BIGINT AS balance_before,
  arg_max(balance_after, event_id)::BIGINT AS balance_after FROM ({BALANCE_SQL}) WHERE change_type = 'CONSUME' GROUP BY ALL"""
SNAPSHOT_SQL = f"""SELECT user_id, token_type, sum(amount)::BIGINT AS used, count(*) AS requests, greatest({LIMIT} - sum(amount), 0)::BIGINT AS remaining, round(sum(amount) / {LIMIT}.0::DOUBLE, 6) AS ratio
  FROM ({LEDGER_SQL}) WHERE change_type = 'CONSUME' AND record_date = (SELECT max(ts)::DATE FROM events) GROUP BY ALL"""


def daily_usage_by_type(spark: SparkSession, d: str) -> DataFrame:
    return usage.consumed_by_day(tables.ledger(spark, d))


def daily_chat_count(spark: SparkSession, d: str) -> DataFrame:
    return usage.chats_by_day(tables.ledger(spark, d))


def daily_usage_spine(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_spine(tables.ledger(spark, d), 30)


def ledger_daily_consume(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_ledger(tables.ledger(spark, d))


def balance_running(spark: SparkSession, d: str) -> DataFrame:
    return usage.with_balance(tables.ledger(spark, d)).select("event_id", "user_id", "balance_before", "balance_after")


def usage_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return usage.snapshot(tables.ledger(spark, d), LIMIT)


def top_consumers_today(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_consumers(usage.snapshot(tables.ledger(spark, d), LIMIT), tables.users(spark, d), "LLM")


def low_balance_users(spark: SparkSession, d: str) -> DataFrame:
    return usage.low_balances(usage.daily_ledger(tables.ledger(spark, d)))


def usage_alerts(spark: SparkSession, d: str) -> DataFrame:
    return usage.alerts(usage.snapshot(tables.ledger(spark, d), LIMIT), LIMIT)


def rate_limit_anchored(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    return usage.anchored_windows(clicks, most=2, seconds=172_800)


def quota_daily_rollback(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_quota(tables.ledger(spark, d).where("change_type = 'CONSUME'"), LIMIT)


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rank: the ceil(p n)-th smallest; and the mean, rounded."""
    rows = table(spark, d, "events").select("event_type", F.floor("value").cast("long").alias("ms"))
    p = {f"p{int(100 * q)}": F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)").cast("long") for q in (0.5, 0.95, 0.99)}
    return rows.groupBy("event_type").agg(*(v.alias(k) for k, v in p.items()), F.floor(F.avg("ms") + 0.5).cast("long").alias("mean"), F.count("*").alias("n"))


def stagnation_runs(spark: SparkSession, d: str) -> DataFrame:
    """Errors stand for turns without a tool call."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return memory.runs(table(spark, d, "events").select("event_id", "user_id", kind.alias("tool")), "user_id", "event_id", "tool", 3)


def messages_time_filter(spark: SparkSession, d: str) -> DataFrame:
    """Closed bounds on stored text times; a text that is no time is kept."""
    stamp = F.when(F.col("event_id") % 97 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    at = values.parse_time(F.col("stamp"))
    inside = at.between(F.to_timestamp(F.lit("2024-01-10 00:00:00")), F.to_timestamp(F.lit("2024-01-12 12:00:00")))
    return table(spark, d, "events").withColumn("stamp", stamp).where(at.isNull() | inside).select("event_id", "stamp")


def json_props_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("largest"), F.count(k).alias("n"))


def json_fact_filter(spark: SparkSession, d: str) -> DataFrame:
    """Facts told as fenced JSON, one list for each event."""
    one = F.format_string('{"content":"  user %s   did %s ","type":"%s","scope":"USER","confidence":%s}', F.col("user_id").cast("string"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "PREFERENCE").otherwise("GUESS"), F.when(F.col("event_id") % 3 == 0, "0.6").otherwise("0.7"))
    told = F.concat(F.lit("```json\n["), one, F.lit("]\n```"))
    rows = table(spark, d, "events").select("event_id", F.explode(values.facts(told)).alias("f"))
    return rows.select("event_id", "f.content", "f.type", "f.scope")


def price_format(spark: SparkSession, d: str) -> DataFrame:
    cents = values.yuan_to_cents(F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", cents.alias("cents"), values.cents_to_yuan(cents).alias("shown"))


def package_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Packages in order, and what a custom recharge of the same price is worth at the base package's tokens a cent."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), F.col("p_size").alias("sort_order"), (F.col("p_partkey") % 11 == 0).alias("deleted"))
    return p.where("NOT deleted AND price > 1").select("id", "price", "sort_order", (F.col("price") * 100).alias("custom_tokens"))


def recharge_orders_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status; a trade number that succeeds several times is credited once."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 9000).alias("trade_no"), F.when(F.col("o_orderstatus") == "F", "SUCCEED").when(F.col("o_orderstatus") == "O", "NOT_PAY").otherwise("PAYING").alias("status"))
    return o.groupBy("status").agg(F.count("*").alias("callbacks"), F.countDistinct("trade_no").alias("orders"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return files.keep_first(o, ["o_custkey"], [F.desc("day"), F.desc("o_orderkey")])


def upload_progress(spark: SparkSession, d: str) -> DataFrame:
    f, p = _uploads(spark, d)
    return files.progress(f, p)


def uploaded_parts_missing(spark: SparkSession, d: str) -> DataFrame:
    return files.missing_parts(*_uploads(spark, d))


def _uploads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), (F.floor("o_totalprice") * 100).cast("long").alias("total_size"))
    return f, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") - 1).alias("part"))


_RECURSE = """WITH RECURSIVE e AS ({rows}), f AS (SELECT *, {first} FROM e WHERE r = 1 UNION ALL SELECT e.*, {next} FROM f JOIN e ON {same} AND e.r = f.r + 1) SELECT {out} FROM f"""
_UPLOADS_SQL = "f AS (SELECT o_orderkey AS file_id, ceil(floor(o_totalprice) * 100 / 5242880.0)::BIGINT AS expected FROM orders), p AS (SELECT DISTINCT l_orderkey AS file_id, (l_linenumber - 1)::BIGINT AS part FROM lineitem)"

CATALOG = {
    "daily_usage_by_type": (daily_usage_by_type, f"SELECT record_date, token_type, sum(amount)::BIGINT AS tokens, count(*) AS requests FROM ({LEDGER_SQL}) WHERE change_type = 'CONSUME' GROUP BY ALL"),
    "daily_chat_count": (daily_chat_count, "SELECT ts::DATE AS record_date, count(*) AS chats, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"),
    "daily_usage_spine": (daily_usage_spine, f"""WITH l AS ({LEDGER_SQL}), s AS (SELECT (max(record_date) - i::INTEGER)::DATE AS record_date FROM l, (SELECT unnest(generate_series(0, 29)) AS i) GROUP BY i) SELECT s.record_date, coalesce(sum(amount) FILTER (WHERE change_type = 'CONSUME' AND token_type = 'LLM'), 0)::BIGINT AS llm_tokens, count(*) FILTER (WHERE change_type = 'CONSUME' AND token_type = 'LLM') AS llm_requests, coalesce(sum(amount) FILTER (WHERE change_type = 'CONSUME' AND token_type = 'EMBEDDING'), 0)::BIGINT AS embedding_tokens, count(*) FILTER (WHERE change_type = 'CONSUME' AND token_type = 'EMBEDDING') AS embedding_requests, count(event_id) AS chats FROM s LEFT JOIN l ON l.record_date = s.record_date GROUP BY s.record_date"""),
    "ledger_daily_consume": (ledger_daily_consume, DAILY_SQL),
    "balance_running": (balance_running, f"SELECT event_id, user_id, balance_before::BIGINT AS balance_before, balance_after::BIGINT AS balance_after FROM ({BALANCE_SQL})"),
    "usage_snapshot": (usage_snapshot, SNAPSHOT_SQL),
    "top_consumers_today": (top_consumers_today, f"SELECT t.user_id, coalesce(c_name, 'Unknown User') AS username, used, requests FROM (SELECT * FROM ({SNAPSHOT_SQL}) WHERE token_type = 'LLM' ORDER BY used DESC, user_id LIMIT 5) t LEFT JOIN customer ON c_custkey::VARCHAR = t.user_id WHERE used > 0"),
    "low_balance_users": (low_balance_users, f"SELECT user_id, token_type, record_date, amount, balance_after, CASE WHEN amount <= 0 THEN 'critical' ELSE 'warning' END AS level FROM ({DAILY_SQL}) o WHERE record_date = (SELECT max(record_date) FROM ({DAILY_SQL}) i WHERE i.user_id = o.user_id AND i.token_type = o.token_type) AND balance_after <= 9300"),
    "usage_alerts": (usage_alerts, f"SELECT user_id, token_type, used, ratio, level, row_number() OVER (ORDER BY level = 'critical', ratio DESC, user_id, token_type)::INTEGER AS rank FROM (SELECT *, CASE WHEN remaining = 0 THEN 'critical' WHEN used / {LIMIT}.0 >= 0.8 THEN 'warning' END AS level FROM ({SNAPSHOT_SQL}) WHERE used > 0) WHERE level IS NOT NULL"),
    "rate_limit_anchored": (rate_limit_anchored, _RECURSE.format(rows="SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'click'", first="us AS began, 1 AS n", next="CASE WHEN e.us >= f.began + 172800000000 THEN e.us ELSE f.began END, CASE WHEN e.us >= f.began + 172800000000 THEN 1 ELSE f.n + 1 END", same="e.user_id = f.user_id", out="event_id, user_id, n <= 2 AS accepted")),
    "quota_daily_rollback": (quota_daily_rollback, _RECURSE.format(rows=f"SELECT event_id, user_id, record_date, amount, row_number() OVER (PARTITION BY user_id, record_date ORDER BY event_id) AS r FROM ({LEDGER_SQL}) WHERE change_type = 'CONSUME'", first=f"CASE WHEN amount <= {LIMIT} THEN amount ELSE 0 END AS used, amount <= {LIMIT} AS accepted", next=f"f.used + CASE WHEN f.used + e.amount <= {LIMIT} THEN e.amount ELSE 0 END, f.used + e.amount <= {LIMIT}", same="e.user_id = f.user_id AND e.record_date = f.record_date", out="event_id, user_id, record_date, amount, accepted")),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, s[ceil(0.5 * n)::INTEGER] AS p50, s[ceil(0.95 * n)::INTEGER] AS p95, s[ceil(0.99 * n)::INTEGER] AS p99, mean, n FROM (SELECT event_type, list_sort(list(floor(value)::BIGINT)) AS s, count(*) AS n, floor(avg(floor(value)) + 0.5)::BIGINT AS mean FROM events GROUP BY event_type)"),
    "stagnation_runs": (stagnation_runs, """WITH e AS (SELECT event_id, user_id, nullif(event_type, 'error') AS tool FROM events), a AS (SELECT *, CASE WHEN lag(tool) OVER w = tool THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM a), c AS (SELECT *, CASE WHEN tool IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) END::INTEGER AS run FROM b) SELECT event_id, user_id, tool, run, run >= 3 AS stagnant FROM c"""),
    "messages_time_filter": (messages_time_filter, "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS stamp FROM events WHERE event_id % 97 = 0 OR date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"),
    "json_props_parse": (json_props_parse, "SELECT event_type, sum(k)::BIGINT AS total, max(k) AS largest, count(k) AS n FROM (SELECT event_type, regexp_extract(props, '\"k\": *(\\d+)', 1)::INTEGER AS k FROM events) GROUP BY event_type"),
    "json_fact_filter": (json_fact_filter, "SELECT event_id, 'user ' || user_id || ' did ' || event_type AS content, CASE WHEN event_id % 2 = 0 THEN 'PREFERENCE' ELSE 'FACT' END AS type, 'USER' AS scope FROM events WHERE event_id % 3 <> 0"),
    "price_format": (price_format, "SELECT p_partkey, c AS cents, regexp_replace(regexp_replace(printf('%.2f', c / 100.0), '\\.00$', ''), '(\\.\\d)0$', '\\1') AS shown FROM (SELECT p_partkey, ceil(p_retailprice::DECIMAL(20, 6) * 100 - 0.5)::BIGINT AS c FROM part)"),
    "package_tokens": (package_tokens, "SELECT p_partkey AS id, round(p_retailprice * 100)::BIGINT AS price, p_size AS sort_order, round(p_retailprice * 100)::BIGINT * 100 AS custom_tokens FROM part WHERE p_partkey % 11 <> 0 AND p_retailprice > 0.01"),
    "recharge_orders_by_status": (recharge_orders_by_status, "SELECT CASE o_orderstatus WHEN 'F' THEN 'SUCCEED' WHEN 'O' THEN 'NOT_PAY' ELSE 'PAYING' END AS status, count(*) AS callbacks, count(DISTINCT o_orderkey % 9000) AS orders FROM orders GROUP BY ALL"),
    "latest_per_key": (latest_per_key, "SELECT o_custkey, o_orderkey, day, o_orderstatus FROM (SELECT *, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "upload_progress": (upload_progress, f"WITH {_UPLOADS_SQL} SELECT f.file_id, count(part) AS uploaded, expected, CASE WHEN expected = 0 THEN 0.0 ELSE round(count(part) * 100.0::DOUBLE / expected, 6) END AS percent FROM f LEFT JOIN p ON p.file_id = f.file_id GROUP BY f.file_id, expected"),
    "uploaded_parts_missing": (uploaded_parts_missing, f"WITH {_UPLOADS_SQL} SELECT file_id, part FROM (SELECT file_id, unnest(generate_series(0, expected - 1)) AS part FROM f WHERE expected > 0) w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.file_id = w.file_id AND p.part = w.part)"),
}
