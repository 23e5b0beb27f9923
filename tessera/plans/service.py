"""Memory, quota, upload and answer queries: name -> (query, SQL of the same rows or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.operators import chunking, files, memory, retrieval, usage
from tessera.plans.knowledge import tokens_sql
from tessera.plans.search import FILES_SQL, QUERY, RRF_SQL, TOP, VISIBLE_SQL, bm25_ranked_sql, chunks, few, hybrid_search_rrf, lexical
from tessera.plans.usage import _RECURSE, LEDGER_SQL, LIMIT, SNAPSHOT_SQL
from tessera.sources import tables
from tessera.sources.tables import table

BUDGET, WINDOW = 400, 259_200
PARENT = 4096
SIMILAR = 0.2

# Fixed text of a tool's answer with search results.
FOUND = "检索到 {} 个知识库片段。请基于这些片段回答用户问题；不得声称知识库暂无相关信息。如果片段信息不足，请说明“基于已检索片段只能确认……”并标注来源编号。"


def memories(spark: SparkSession, d: str) -> DataFrame:
    """chat_memories: one for each message, and a second one with the same content for every third turn."""
    m = table(spark, d, "conversations")
    once = m.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 5).alias("user_id"),
        F.when(F.col("role") == "user", "USER").otherwise("CONVERSATION").alias("scope"),
        F.col("conv_id").alias("conversation_id"),
        F.col("text").alias("content"),
        F.when(F.col("turn") % 5 == 0, "PREFERENCE").otherwise("FACT").alias("type"),
        F.col("turn").alias("updated"),
    )
    return once.union(once.where("updated % 3 = 0").withColumn("id", F.col("id") + 1_000_000_000))


_MEMORY = "SELECT conv_id * 1000 + turn AS id, conv_id % 5 AS user_id, CASE WHEN role = 'user' THEN 'USER' ELSE 'CONVERSATION' END AS scope, conv_id AS conversation_id, text AS content, CASE WHEN turn % 5 = 0 THEN 'PREFERENCE' ELSE 'FACT' END AS type, turn AS updated FROM conversations"
MEMORIES_SQL = f"{_MEMORY} UNION ALL SELECT id + 1000000000, * EXCLUDE (id) FROM ({_MEMORY}) WHERE updated % 3 = 0"


def memory_visible(spark: SparkSession, d: str) -> DataFrame:
    return memory.visible_memories(memories(spark, d), 2, 3).select("id", "scope", "content")


def memory_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return memory.distinct_memories(memories(spark, d)).select("id", "user_id", "scope", "content")


def runtime_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return rows.withColumn("tokens", tx.estimate_tokens(F.col("text")))


def runtime_compaction_split(spark: SparkSession, d: str) -> DataFrame:
    """Limits scaled to short conversations: 100 tokens, 3 entries kept."""
    return memory.runtime_split(runtime_entries(spark, d), 100, 3).select("conv_id", "turn", "role", "summarise")


def runtime_compaction(spark: SparkSession, d: str) -> DataFrame:
    return memory.compact_runtime(runtime_entries(spark, d), lambda texts: " / ".join(" ".join(t.split()[:5]) for t in texts), 100, 3)


def feedback_last5(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback: the value's whole hundreds as rating, the type as reason."""
    rows = table(spark, d, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), F.floor(F.col("value") / 100).cast("int").alias("rating"), F.nullif(F.col("event_type"), F.lit("error")).alias("reason"))
    return memory.last_feedback(rows)


def explicit_memories(spark: SparkSession, d: str) -> DataFrame:
    """Messages of every third turn ask to remember, with a word of preference in every sixth."""
    asks = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("请帮我记住： "), F.when(F.col("turn") % 2 == 0, "我喜欢 ").otherwise(""), "text")).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", tx.explicit_memory(asks).alias("content"))
    return rows.where("content is not null").withColumn("type", tx.memory_type(F.col("content")))


def session_list(spark: SparkSession, d: str) -> DataFrame:
    return memory.sessions(table(spark, d, "conversations"))


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    """Files as answered: with the tag's name, or the tag itself where it has none."""
    f = tables.files(spark, d).withColumn("org_tag", F.when(F.col("doc_id") % 3 == 0, F.col("org_tag")).otherwise(F.concat(F.lit("N"), F.col("doc_id") % 40)))
    names = tables.tags(spark, d).select(F.col("tag_id").alias("org_tag"), F.col("name").alias("tag_name"))
    return f.join(names, "org_tag", "left").select("doc_id", "file_md5", "file_name", "total_size", "org_tag", F.coalesce("tag_name", "org_tag").alias("org_tag_name"), "is_public")


def reference_map(spark: SparkSession, d: str) -> DataFrame:
    """[n] -> reference of the latest search's hits, as a map, exploded."""
    hits = few(hybrid_search_rrf(spark, d))
    ref = F.struct("doc_id", "chunk_id", F.coalesce("file_name", F.lit("unknown")).alias("file_name"), "content_md5", "score")
    whole = hits.agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank").alias("key"), ref.alias("value")))).alias("mapping"))  # TOP entries
    return whole.select(F.explode("mapping").alias("reference", "r")).select("reference", "r.*")


def search_results_text(spark: SparkSession, d: str) -> DataFrame:
    """The tool's answer as one text."""
    top = few(lexical(spark, d, 5))
    own = tables.files(spark, d).join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")  # 5 rows at most
    texts = chunking.chunk_characters(own, ["doc_id", "file_md5", "file_name"], 512, 51)
    one = F.concat(
        F.lit("\n\n["), F.col("rank").cast("string"), F.lit("] "), F.when(F.length(F.trim("file_name")) > 0, F.concat("file_name", F.lit(" "))).otherwise(""),
        F.lit("(fileMd5="), "file_md5", F.lit(", chunkId="), F.col("chunk_id").cast("string"), F.lit(", score="), F.format_string("%.4f", F.col("bm25")), F.lit(")\n"), tx.truncate(F.col("content"), 1200, "..."),
    )
    rows = top.select("rank", "doc_id", "chunk_id", "bm25").join(texts, ["doc_id", "chunk_id"]).select("rank", one.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    head = F.concat(F.lit(FOUND.split("{}")[0]), F.count("*").cast("string"), F.lit(FOUND.split("{}")[1]))
    return rows.agg(F.concat(head, F.array_join(lines, "")).alias("answer"))


def tool_result_limits(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("p_size") % 7 > 0, F.col("p_size") - 10)
    return table(spark, d, "part").select("p_partkey", usage.result_limit(asked).alias("top_k"))


def token_budget_anchored(spark: SparkSession, d: str) -> DataFrame:
    return usage.token_budgets(tables.ledger(spark, d).where("change_type = 'CONSUME'"), BUDGET, WINDOW)


def compound_reservation(spark: SparkSession, d: str) -> DataFrame:
    return usage.compound_reservations(tables.ledger(spark, d).where("change_type = 'CONSUME'"), 150, ((200, 86_400), (500, 604_800)))


def quota_settled(spark: SparkSession, d: str) -> DataFrame:
    """Every reservation of twice the amount is settled, or aborted where the amount is odd."""
    rows = tables.ledger(spark, d).where("change_type = 'CONSUME'").withColumn("reserved", F.col("amount") * 2)
    kinds = F.array(F.lit("RESERVE"), F.when(F.col("amount") % 2 == 1, "ABORT").otherwise("SETTLE"))
    return usage.settled_usage(rows.select("user_id", "record_date", "reserved", F.col("amount").alias("actual"), F.explode(kinds).alias("kind")))


def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    users = tables.users(spark, d).select(F.col("id").cast("string").alias("user_id"))
    kinds = F.explode(F.array(*(F.struct(F.lit(t).alias("token_type"), F.lit(c).alias("change_type")) for t in ("LLM", "EMBEDDING") for c in ("INCREASE", "CONSUME"))))
    return usage.totals(tables.ledger(spark, d), users.select("user_id", kinds.alias("k")).select("user_id", "k.*"))


def balance_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return usage.balance_snapshot(tables.ledger(spark, d))


def top_users_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_by_scope(usage.snapshot(tables.ledger(spark, d), LIMIT))


def user_snapshots(spark: SparkSession, d: str) -> DataFrame:
    users = tables.users(spark, d).withColumn("username", F.when(F.col("id") % 10 == 0, F.concat(F.lit("system-"), "id")).otherwise(F.col("username")))
    snapshot = usage.snapshot(tables.ledger(spark, d), LIMIT).where("token_type = 'LLM'")
    return usage.with_snapshots(users, snapshot, LIMIT)


def lease_sessions(spark: SparkSession, d: str) -> DataFrame:
    """How many stretches of renewed two-day leases each user has."""
    return usage.idle_sessions(table(spark, d, "events"), 2).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def upload_parts_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Line items as parts: those of even orders' first lines are there already."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") % 4).alias("part"), F.concat_ws("|", "l_partkey", "l_suppkey").cast("binary").alias("content"), F.expr("l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey").alias("seq"))
    received = parts.where("file_id % 2 = 0 AND seq < 20000000000")
    return files.accept_parts(received, parts).select("file_id", "part", "chunk_md5")


def latest_update(spark: SparkSession, d: str) -> DataFrame:
    """The last update of completed uploads: merged, else created. Orders stand for uploads."""
    merged = F.when(F.col("o_orderkey") % 2 == 0, F.date_add(F.to_date("o_orderdate"), 3))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.max(F.coalesce(merged, F.to_date("o_orderdate"))).alias("latest"))


def file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files by user: all, completed, and those with a further copy of the same content."""
    f = tables.files(spark, d).withColumn("copies", F.count("*").over(Window.partitionBy("file_md5")))
    return f.groupBy("user_id").agg(F.count("*").alias("files"), F.count_if(F.col("status") == 1).alias("completed"), F.count_if(F.col("copies") > 1).alias("with_copies"))


def stale_versions(spark: SparkSession, d: str) -> DataFrame:
    f = tables.files(spark, d).select(F.col("user_id").alias("owner"), "file_name", "file_md5", F.col("doc_id").alias("id"))
    return files.stale_versions(f)


def bootstrap_ready(spark: SparkSession, d: str) -> DataFrame:
    """Readiness of each content: its chunks, an index that lacks user 20's, and the vectors as parts."""
    f = tables.files(spark, d)
    first = files.keep_first(f.drop("text"), ["file_md5"], ["doc_id"])
    c = chunks(spark, d).select("file_md5", "user_id")
    parts = f.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return files.ready(first, c, c.where("user_id <> 20"), parts, 7, "src-fr").groupBy("ready").agg(F.count("*").alias("files"))


def stream_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Event-stream chunks made of events: comments, blank lines and payloads with and without prefix."""
    chunk = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" :ping "), "event_type")).otherwise(F.concat(F.lit("data: "), "props", F.lit("\r\n\n:ping\n"), "event_type", F.lit("\n data:[DONE] \n")))
    return table(spark, d, "events").select("event_id", F.posexplode(tx.stream_payloads(chunk)).alias("pos", "payload"))


def parent_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = chunking.parent_blocks(table(spark, d, "documents"), ["doc_id"], PARENT)
    return blocks.select("doc_id", "block", F.md5("text").alias("text_md5"))


def similar_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label in order: which one is like the one before it, and so in one block with it."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    return chunking.merge_similar(rows, "label", "vec_id", "embedding", SIMILAR).select("label", "vec_id", "merged", "block")


def protected_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Fenced code and tables of the documents, one fence of every other document put around its text."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a\n```\n"), "text", F.lit("\n```\n|x|y|\n|-|-|\nb"))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.explode(chunking.protected_blocks(F.col("text"))).alias("b")).select("doc_id", "b.kind", "b.start", "b.end")


CATALOG = {
    "memory_visible": (memory_visible, f"SELECT id, scope, content FROM ({MEMORIES_SQL}) WHERE (scope = 'USER' AND user_id = 2) OR (scope = 'CONVERSATION' AND conversation_id = 3) ORDER BY updated DESC, id DESC LIMIT 200"),
    "memory_dedupe": (memory_dedupe, f"SELECT min(id) AS id, user_id, scope, content FROM ({MEMORIES_SQL}) GROUP BY user_id, scope, content, CASE WHEN scope = 'CONVERSATION' THEN conversation_id END"),
    "runtime_compaction_split": (runtime_compaction_split, f"WITH t AS (SELECT conv_id, turn, role, {tokens_sql('text')} AS tokens FROM conversations) SELECT conv_id, turn, role, sum(tokens) OVER w >= 100 AND count(*) OVER w > 3 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) > 3 AS summarise FROM t WINDOW w AS (PARTITION BY conv_id)"),
    "runtime_compaction": (runtime_compaction, None),
    "feedback_last5": (feedback_last5, "SELECT user_id, rank, line FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rank, 'rating=' || floor(value / 100)::INTEGER || '; reason=' || coalesce(nullif(event_type, 'error'), '') AS line FROM events) WHERE rank <= 5"),
    "explicit_memories": (explicit_memories, r"WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace((CASE WHEN turn % 2 = 0 THEN '我喜欢 ' ELSE '' END) || text, '\s+', ' ', 'g')) AS content FROM conversations WHERE turn % 3 = 0) SELECT conv_id, turn, role, content, CASE WHEN turn % 2 = 0 THEN 'PREFERENCE' ELSE 'FACT' END AS type FROM c WHERE length(content) BETWEEN 4 AND 1000"),
    "session_list": (session_list, r"WITH s AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '\s+', ' ', 'g')) AS t, count(*) AS messages, max(turn) AS updated FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN length(t) > 20 THEN substr(t, 1, 20) || '…' ELSE t END AS title, messages, updated FROM s ORDER BY updated DESC, conv_id"),
    "file_rows": (file_rows, f"WITH f AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN org_tag ELSE 'N' || (doc_id % 40) END AS org_tag) FROM ({FILES_SQL})) SELECT doc_id, file_md5, file_name, total_size, org_tag, coalesce(n_name, org_tag) AS org_tag_name, is_public FROM f LEFT JOIN nation ON 'N' || n_nationkey = org_tag"),
    "reference_map": (reference_map, f"SELECT r.rank AS reference, r.doc_id, r.chunk_id, c.source AS file_name, md5(substr(c.text, ((r.chunk_id - 1) * 461 + 1)::BIGINT, 512)) AS content_md5, round(r.score, 6) AS score FROM ({RRF_SQL}) r JOIN documents c USING (doc_id) WHERE r.rank <= {TOP}"),
    "search_results_text": (search_results_text, f"SELECT '{FOUND.split('{}')[0]}' || count(*) || '{FOUND.split('{}')[1]}' || string_agg(chr(10) || chr(10) || '[' || rank || '] ' || CASE WHEN length(trim(source)) > 0 THEN source || ' ' ELSE '' END || '(fileMd5=' || md5(text) || ', chunkId=' || chunk_id || ', score=' || printf('%.4f', bm25) || ')' || chr(10) || substr(text, ((chunk_id - 1) * 461 + 1)::BIGINT, 512), '' ORDER BY rank) AS answer FROM {bm25_ranked_sql(VISIBLE_SQL, 5)} h JOIN documents d ON d.doc_id = h.doc_id"),
    "tool_result_limits": (tool_result_limits, "SELECT p_partkey, greatest(1, least(20, coalesce(CASE WHEN p_size % 7 > 0 THEN p_size - 10 END, 5)))::INTEGER AS top_k FROM part"),
    "token_budget_anchored": (token_budget_anchored, _RECURSE.format(rows=f"SELECT event_id, user_id, epoch_us(ts) AS us, amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM ({LEDGER_SQL}) WHERE change_type = 'CONSUME'", first=f"us AS began, CASE WHEN amount <= {BUDGET} THEN amount ELSE 0 END AS used, amount <= {BUDGET} AS ok", next=f"CASE WHEN f.used = 0 OR e.us >= f.began + {WINDOW}000000 THEN e.us ELSE f.began END, CASE WHEN e.us >= f.began + {WINDOW}000000 THEN 0 ELSE f.used END + CASE WHEN CASE WHEN e.us >= f.began + {WINDOW}000000 THEN 0 ELSE f.used END + e.amount <= {BUDGET} THEN e.amount ELSE 0 END, CASE WHEN e.us >= f.began + {WINDOW}000000 THEN 0 ELSE f.used END + e.amount <= {BUDGET}", same="e.user_id = f.user_id", out="event_id, user_id, ok AS accepted")),
    "compound_reservation": (compound_reservation, None),
    "quota_settled": (quota_settled, f"SELECT user_id, record_date, sum(CASE WHEN amount % 2 = 1 THEN 0 ELSE amount END)::BIGINT AS used FROM ({LEDGER_SQL}) WHERE change_type = 'CONSUME' GROUP BY ALL"),
    "ledger_totals": (ledger_totals, f"WITH k AS (SELECT c_custkey::VARCHAR AS user_id, t AS token_type, c AS change_type FROM customer, (VALUES ('LLM'), ('EMBEDDING')) a(t), (VALUES ('INCREASE'), ('CONSUME')) b(c)) SELECT k.user_id, k.token_type, k.change_type, coalesce(sum(amount), 0)::BIGINT AS amount FROM k LEFT JOIN ({LEDGER_SQL}) l ON l.user_id = k.user_id AND l.token_type = k.token_type AND l.change_type = k.change_type GROUP BY ALL"),
    "balance_snapshot": (balance_snapshot, f"SELECT user_id, (10000 + sum(CASE WHEN change_type = 'INCREASE' THEN amount ELSE 0 END))::BIGINT AS granted, (10000 + sum(CASE WHEN change_type = 'INCREASE' THEN amount ELSE -amount END))::BIGINT AS balance, sum(CASE WHEN change_type = 'CONSUME' THEN amount ELSE 0 END)::BIGINT AS used FROM ({LEDGER_SQL}) GROUP BY user_id"),
    "top_users_by_scope": (top_users_by_scope, f"SELECT token_type, rank, user_id, used FROM (SELECT *, row_number() OVER (PARTITION BY token_type ORDER BY used DESC, user_id)::INTEGER AS rank FROM ({SNAPSHOT_SQL}) WHERE used > 0) WHERE rank <= 5"),
    "user_snapshots": (user_snapshots, f"SELECT c_custkey AS id, c_name AS username, coalesce(used, 0) AS used, coalesce(remaining, {LIMIT})::BIGINT AS remaining, coalesce(requests, 0) AS requests FROM customer LEFT JOIN (SELECT * FROM ({SNAPSHOT_SQL}) WHERE token_type = 'LLM') s ON s.user_id = c_custkey::VARCHAR WHERE c_custkey % 10 <> 0"),
    "lease_sessions": (lease_sessions, "SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY > ts THEN 0 ELSE 1 END AS new FROM events) GROUP BY user_id"),
    "upload_parts_accepted": (upload_parts_accepted, "WITH p AS (SELECT l_orderkey AS file_id, l_linenumber % 4 AS part, l_partkey || '|' || l_suppkey AS content, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq FROM lineitem) SELECT file_id, part, md5(arg_min(content, seq)) AS chunk_md5 FROM p WHERE NOT (file_id % 2 = 0 AND (file_id, part) IN (SELECT (file_id, part) FROM p WHERE seq < 20000000000)) GROUP BY file_id, part"),
    "latest_update": (latest_update, "SELECT max(o_orderdate::DATE + CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END) AS latest FROM orders WHERE o_orderstatus = 'F'"),
    "file_counts": (file_counts, f"SELECT user_id, count(*) AS files, count(*) FILTER (WHERE status = 1) AS completed, count(*) FILTER (WHERE copies > 1) AS with_copies FROM (SELECT doc_id % 50 AS user_id, 1 AS status, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) GROUP BY user_id"),
    "stale_versions": (stale_versions, f"WITH f AS ({FILES_SQL}), c AS (SELECT user_id, file_name, arg_max(file_md5, doc_id) AS current FROM f GROUP BY ALL) SELECT DISTINCT user_id AS owner, file_name, file_md5 FROM f JOIN c USING (user_id, file_name) WHERE file_md5 <> current"),
    "bootstrap_ready": (bootstrap_ready, f"WITH f AS ({FILES_SQL}), n AS (SELECT file_md5, sum(greatest(ceil((length(text) - 51) / 461.0), 1)) FILTER (WHERE length(text) > 0) AS c, sum(greatest(ceil((length(text) - 51) / 461.0), 1)) FILTER (WHERE length(text) > 0 AND user_id <> 20) AS i, count(*) FILTER (WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS p, arg_min(user_id, doc_id) AS u, arg_min(org_tag, doc_id) AS t FROM f GROUP BY file_md5) SELECT coalesce(c > 0 AND c = i AND p > 0 AND u = 7 AND t = 'src-fr', false) AS ready, count(*) AS files FROM n GROUP BY ALL"),
    "stream_payloads": (stream_payloads, "SELECT event_id, pos::INTEGER AS pos, payload FROM (SELECT event_id, 0 AS pos, ':ping ' || event_type AS payload FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, unnest([0, 1, 2]), unnest([props, event_type, '[DONE]']) FROM events WHERE event_id % 5 <> 0)"),
    "parent_blocks": (parent_blocks, f"SELECT doc_id, (i + 1)::INTEGER AS block, md5(substr(text, (i * {PARENT} + 1)::BIGINT, {PARENT})) AS text_md5 FROM (SELECT doc_id, text, unnest(generate_series(0, ceil(length(text) / {PARENT}.0)::BIGINT - 1)) AS i FROM documents WHERE length(text) > 0)"),
    "similar_neighbours": (similar_neighbours, f"WITH s AS (SELECT label, vec_id, coalesce(list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w) >= {SIMILAR}, false) AS merged FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, vec_id, merged, sum((NOT merged)::INTEGER) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS block FROM s"),
    "protected_blocks": (protected_blocks, None),
}
