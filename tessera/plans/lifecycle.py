"""State, control rules, stored tables and answers: name -> (query, SQL of the same rows or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.functions import values
from tessera.operators import access, chunking, control, files, keyed_table, memory, retrieval, segmenting, text_index, usage
from tessera.plans.knowledge import RECALL, tokens_sql
from tessera.plans.search import CHUNKS_SQL, FILES_SQL, OVERLAP, QUERY, RRF_SQL, SIZE, TOP, VISIBLE_SQL, bm25_ranked_sql, chunks, few, hybrid_search_rrf, knn_sql, lexical, r6
from tessera.plans.service import MEMORIES_SQL, memories
from tessera.plans.usage import LEDGER_SQL, LIMIT, SNAPSHOT_SQL
from tessera.sources import tables
from tessera.sources.shared import shared_folder
from tessera.sources.tables import table
from tessera.streaming import sessions

DAY_US = 86_400 * 1_000_000
PARENT = 4096
MATCHED, SUMMARY = 800, 1800
# Fixed text: what the answer says of how a reference was found.
HYBRID_LABEL, TEXT_LABEL = "混合召回（语义相关 + 关键词命中）", "关键词召回"


def generation_states(spark: SparkSession, d: str) -> DataFrame:
    """Events as generations with a lease of a day: a purchase completes one, an error fails it, others are chunks."""
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("chunk")
    g = sessions.generations(table(spark, d, "events").select("user_id", "ts", kind.alias("kind")), 86_400)
    return g.select("user_id", "status", "chunks", *(F.unix_micros(c).alias(f"{c}_us") for c in ("began", "ended", "expires")))


def conversation_leases(spark: SparkSession, d: str) -> DataFrame:
    """Current conversations of seven days from their creation."""
    return sessions.conversations(table(spark, d, "events")).select("user_id", F.unix_micros("began").alias("began_us"), "events")


def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    """File rows after newer ones of some, and of new files, were put in place and others deleted, by key ranges."""
    rows, folder = tables.files(spark, d).select("doc_id", "file_md5", "total_size"), shared_folder(spark, "files")
    keyed_table.create(rows, folder, "doc_id", 5000)
    newer = rows.where("doc_id BETWEEN 100 AND 180").withColumn("total_size", F.col("total_size") + 1)
    keyed_table.upsert(newer.union(rows.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000)), folder, 5000)
    keyed_table.delete(rows.where("doc_id < 20").select("doc_id"), folder, 5000)
    return keyed_table.read(spark, folder)


def learned_words(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of two and three letters that hold together, learned as for a script without spaces."""
    docs = table(spark, d, "documents").select(F.lower("text").alias("text"))
    return segmenting.learn_words(docs, letter="[a-z]", longest=3, least=50, firmness=2.0, most=None)


def knowledge_stats_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents, live and deleted fragments of a stored index, and the time of its latest file: when the last merged one was merged."""
    folder, f = shared_folder(spark, "index"), tables.files(spark, d)
    text_index.add(chunks(spark, d), folder, retrieval.CHUNK)
    m = text_index.delete(spark, folder, f.where("user_id = 3").select("doc_id"))
    merged = F.when(F.col("doc_id") % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7919 % 1000).cast("int")))
    f = f.withColumns({"merged": merged, "created": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int"))})
    latest = F.max_by(F.coalesce("merged", "created"), F.struct(F.coalesce("merged", F.lit("0001-01-01").cast("date")), "doc_id"))
    return f.agg(F.count("*").alias("documents"), F.lit(m.chunks).cast("long").alias("fragments"), F.lit(text_index.deleted(spark, folder, m)).cast("long").alias("deleted"), latest.alias("latest"))


def hybrid_search_public(spark: SparkSession, d: str) -> DataFrame:
    """A search without a user: public documents only, on both arms."""
    near = retrieval.knn(_owned(spark, d).where("is_public"), _query(spark, d), retrieval.CHUNK, TOP)
    return retrieval.fuse(lexical(spark, d, 5 * TOP, public_only=True), near, retrieval.CHUNK, TOP).select("rank", "doc_id", "chunk_id", r6("score"))


def _owned(spark: SparkSession, d: str) -> DataFrame:
    owners = tables.files(spark, d).select("doc_id", "user_id", "org_tag", "is_public")
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").join(owners, "doc_id").withColumn("chunk_id", F.lit(1))


def _query(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def hybrid_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search's model is out of reach, so plain BM25 answers; any other failure, and one of BM25 itself, is raised."""

    def hybrid() -> DataFrame:
        raise ConnectionError("no embedding model")

    words = lambda: lexical(spark, d, TOP).select("rank", "doc_id", "chunk_id", "bm25")
    return retrieval.with_fallbacks(spark, [hybrid, words], outages=(ConnectionError, TimeoutError)).select("rank", "doc_id", "chunk_id", r6("bm25"))


def latest_references(searches: DataFrame) -> DataFrame:
    """The references of each generation's last search that found something; searches: generation_id, search, rank and what is shown."""
    last = F.max("search").over(Window.partitionBy("generation_id"))
    return searches.withColumn("__last", last).where(F.col("search") == F.col("__last")).drop("__last", "search")


def reference_details(spark: SparkSession, d: str) -> DataFrame:
    """All that is kept of a reference, of the later of two searches: keywords first, then hybrid."""
    words = few(lexical(spark, d, 10 * TOP))  # one scan serves both searches
    first = words.where(F.col("rank") <= TOP).select(F.lit(1).alias("search"), "rank", "doc_id", "chunk_id", F.col("bm25").alias("score"), F.lit("TEXT_ONLY").alias("mode"))
    then = few(hybrid_search_rrf(spark, d, words).select(F.lit(2).alias("search"), "rank", "doc_id", "chunk_id", "score", F.lit("RRF").alias("mode")))
    hits = latest_references(first.union(then).withColumn("generation_id", F.lit(1)))
    own = tables.files(spark, d).join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")  # TOP rows at most
    texts = chunking.chunk_characters(own, ["doc_id", "file_md5", "file_name"], SIZE, OVERLAP)
    matched = tx.truncate(F.col("content"), MATCHED, "…")
    anchor = F.when(F.col("doc_id") % 4 == 0, tx.anchor_text(F.col("content")))
    rows = hits.join(texts, retrieval.CHUNK)
    return rows.select(
        F.col("rank").alias("reference"), "file_md5", F.coalesce("file_name", F.lit("unknown")).alias("file_name"), F.lit(None).cast("int").alias("page_number"), anchor.alias("anchor_text"), F.col("mode").alias("retrieval_mode"),
        F.when(F.col("mode") == "TEXT_ONLY", TEXT_LABEL).otherwise(HYBRID_LABEL).alias("retrieval_label"), tx.collapse(F.lit(" ".join(QUERY))).alias("retrieval_query"), F.md5(matched).alias("matched_md5"), tx.evidence_snippet(anchor, matched).alias("evidence"), r6("score"), "chunk_id",
    )


def summary_context(spark: SparkSession, d: str) -> DataFrame:
    """The found chunks as one text for a summary."""
    top = few(lexical(spark, d, 5))
    own = tables.files(spark, d).join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")  # 5 rows at most
    texts = chunking.chunk_characters(own, ["doc_id", "file_md5", "file_name"], SIZE, OVERLAP)
    name = F.when(F.length(F.trim("file_name")) > 0, F.concat(F.lit("文件："), F.col("file_name"), F.lit("，"))).otherwise("")
    one = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), name, F.lit("fileMd5="), "file_md5", F.lit("，chunkId="), F.col("chunk_id").cast("string"), F.lit("\n"), tx.truncate(F.col("content"), SUMMARY, "..."), F.lit("\n\n"))
    rows = top.select("rank", *retrieval.CHUNK).join(texts, retrieval.CHUNK).select("rank", one.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "").alias("context"))


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    """What a user is reminded of in a conversation: the visible memories, scored, as far as a budget goes."""
    return memory.recall(memories(spark, d), 2, 3, RECALL, F.col("updated") * 6.0, 400).select("id", "scope", F.round("score", 6).alias("score"), "tokens", "total")


def token_estimate_messages(spark: SparkSession, d: str) -> DataFrame:
    """Whole messages: some with reasoning, some with tool calls (of which some can't be written as JSON), some that answer a call."""
    calls = F.when(F.col("turn") % 4 == 1, F.concat(F.lit('[{"name":"search","turn":'), F.col("turn").cast("string"), F.lit("}]"))).when(F.col("turn") % 4 == 3, "{broken")
    t = memory.whole_message_tokens(F.col("role"), F.col("text"), F.when(F.col("turn") % 3 == 0, F.col("role")), calls, F.when(F.col("turn") % 2 == 0, F.concat(F.lit("call_"), F.col("conv_id").cast("string"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(t).alias("tokens"))


def memory_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries of three roles, cut by role."""
    role = F.element_at(F.array(*map(F.lit, ("user", "assistant", "tool", "system"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", role.alias("role"), F.md5(memory.limited_entry(role, F.col("text"))).alias("entry_md5"))


def file_previews(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("source", F.when(F.col("doc_id") % 5 == 0, ".bin").otherwise(".txt"))
    shown = files.file_preview(name, F.col("doc_id") % 5 != 0, F.col("text"), F.octet_length("text").cast("long"), F.lit("2024-01-01"))
    return table(spark, d, "documents").select("doc_id", F.md5(shown).alias("preview_md5"))


def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of parent blocks, each chunked apart, with ids that run on over a document's blocks."""
    parts = chunking.chunk_characters(chunking.parent_blocks(table(spark, d, "documents"), ["doc_id"], PARENT), ["doc_id", "block"], SIZE, OVERLAP)
    before = F.col("block") - 1
    per_block = -(-(PARENT - OVERLAP) // (SIZE - OVERLAP))  # every block but the last is whole, so its number of chunks is known
    return parts.select("doc_id", "block", (before * per_block + F.col("chunk_id")).cast("int").alias("chunk_id"), F.md5("content").alias("content_md5"))


def quota_daily_usage(spark: SparkSession, d: str) -> DataFrame:
    """More days than counters live are asked for; users whose names begin with 'system' aren't counted."""
    user = F.when(F.col("user_id").cast("long") % 10 == 0, F.concat(F.lit("system"), "user_id")).otherwise(F.col("user_id"))
    return usage.quota_days(tables.ledger(spark, d).withColumn("user_id", user), 99)


def usage_alerts_enabled(spark: SparkSession, d: str) -> DataFrame:
    """Alert levels where every fourth user's quota is switched off."""
    s = usage.snapshot(tables.ledger(spark, d), LIMIT)
    level = usage.alert_level(F.col("used"), F.lit(LIMIT), F.col("remaining"), F.col("user_id").cast("long") % 4 != 0)
    return s.select("user_id", "token_type", level.alias("level"))


def day_ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", values.seconds_to_day_end(F.col("ts")).alias("to_end"), values.retention_seconds(F.col("ts"), 35).alias("kept"))


def discounts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.format_string("%.2f", (F.col("p_partkey") % 1000) / 100.0))
    percent = values.discount_to_percent(F.col("raw"))
    return table(spark, d, "part").withColumn("raw", raw).select("p_partkey", percent.alias("percent"), values.percent_to_discount(percent).alias("shown"), values.legal_price(F.col("raw")).alias("legal"))


def custom_recharge(spark: SparkSession, d: str) -> DataFrame:
    """What an order of any amount is worth at the base package: the enabled one, not deleted, of price 1 (of several the first)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("price"), F.floor("p_retailprice").cast("long").alias("llm_token"), (F.col("p_partkey") % 11 == 0).alias("deleted"), (F.col("p_partkey") % 7 != 0).alias("enabled"))
    base = p.where("enabled AND NOT deleted AND price = 1").agg(F.min_by("llm_token", "id").alias("base"))
    o = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    return o.withColumn("one", F.lit(1)).join(F.broadcast(base.withColumn("one", F.lit(1))), "one").select("o_orderkey", "amount", (F.col("amount") * F.col("base")).alias("tokens"))  # base: one row


def credited_orders(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of successful orders; callbacks that repeat a trade number credit it once."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("trade_no"), F.lit("SUCCEED").alias("status"), F.floor("o_totalprice").cast("long").alias("tokens"))
    return control.credited_tokens(o.union(o.where("trade_no % 3 = 0")).union(o.withColumn("status", F.lit("FAIL"))))


def rate_limits_effective(spark: SparkSession, d: str) -> DataFrame:
    """Defaults for each brand of part, overlaid by what is stored for some, not always whole."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("m"), F.count("*").alias("n"))
    numbers = [F.col(c).cast("long") for c in ("m", "n", "m", "n", "m", "n")]
    names = (*control.SINGLE, *control.DUAL)
    none = F.lit(None).cast("long")
    defaults = p.select(F.col("p_brand").alias("config_key"), *(F.lit(i + 1).cast("long").alias(c) if (i < 2) else none.alias(c) for i, c in enumerate(names)))
    stored = p.select(F.col("p_brand").alias("config_key"), *(F.when(F.col("m") + i != 51, v).alias(c) for i, (c, v) in enumerate(zip(names, numbers, strict=True))))
    return control.effective_limits(defaults, stored.union(stored.limit(1).withColumn("config_key", F.lit("unknown"))))


def invite_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests with a customer's code; suppliers own the codes, of few uses, some expired or switched off."""
    codes = table(spark, d, "supplier").select(F.concat(F.lit("c"), "s_suppkey").alias("code"), (F.col("s_suppkey") % 5 != 0).alias("enabled"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp")).alias("expires_at"), F.lit(1).alias("used_count"), (F.col("s_suppkey") % 4 + 2).cast("int").alias("max_uses"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_custkey") % 50 > 0, F.concat(F.lit("C"), F.col("o_custkey") % 17)).otherwise(" ").alias("code"))
    return control.consume_invites(asked, codes, F.lit("2024-06-01").cast("timestamp"))


def uploads_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Line items as parts of uploads, with an organisation's limit; every tenth supplier's are an administrator's."""
    over = control.upload_rejected((F.col("l_extendedprice") * 1000).cast("long"), F.col("l_linenumber") - 1, F.col("l_quantity").cast("long") * 100_000, F.when(F.col("l_partkey") % 9 > 0, F.lit(20_000_000)), F.col("l_suppkey") % 10 == 0)
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(over).alias("rejected"), F.count("*").alias("parts"))


def assigned_tags(spark: SparkSession, d: str) -> DataFrame:
    """Customers get other tags: private ones stay, and who has no primary tag gets one."""
    u = tables.users(spark, d).withColumn("private", F.concat(F.lit("PRIVATE_"), "id"))
    held = F.when(F.col("id") % 3 == 0, F.regexp_replace("org_tags", ",PRIVATE_.*", "")).otherwise(F.col("org_tags"))
    tags = control.assign_tags(held, F.array(F.lit("R9"), F.lit("N1")))
    return u.withColumn("tags", tags).select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"), control.assign_primary(F.when(F.col("id") % 5 == 0, "N7"), F.col("tags"), F.col("private")).alias("primary_org"))


def files_without_tags(spark: SparkSession, d: str) -> DataFrame:
    """The listing of a user without any tag: own and public files."""
    return tables.files(spark, d).where(access.visible(7, [])).select("doc_id", "user_id", "is_public")


def parts_in_bitmap(spark: SparkSession, d: str) -> DataFrame:
    """Which of 130 parts a bitmap of 128 bits (a text's hash) has."""
    bits = F.expr("sequence(0, 129)")
    rows = table(spark, d, "documents").select("doc_id", F.unhex(F.md5("text")).alias("bitmap"), F.explode(bits).alias("part"))
    return rows.where(values.part_received(F.col("bitmap"), F.col("part"))).groupBy("doc_id").agg(F.count("*").alias("received"), F.min("part").alias("first"), F.max("part").alias("last"))


def context_triggers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", values.context_trigger(F.col("p_size") * 1000, F.col("p_partkey") % 100 / 80.0).alias("trigger"))


def conversations_between(spark: SparkSession, d: str) -> DataFrame:
    """Events between two times, both counted in, of one user and of all."""
    bounds = (F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    rows = table(spark, d, "events").where(values.between(F.col("ts").cast("timestamp"), *bounds))
    return rows.agg(F.count("*").alias("all_users"), F.count_if(F.col("user_id") == 7).alias("one_user"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def json_failures(spark: SparkSession, d: str) -> DataFrame:
    """Properties of which some are cut short: what can't be read is null and loses no row."""
    props = F.when(F.col("event_id") % 10 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    k = F.from_json(props, "k INT", {"mode": "PERMISSIVE"})["k"]
    told = F.when(k.isNotNull(), F.to_json(F.struct(k.alias("k"))))
    return table(spark, d, "events").select("event_id", k.alias("k"), told.alias("told"))


def pdf_magic(spark: SparkSession, d: str) -> DataFrame:
    """Contents that begin as a PDF does, whatever their name."""
    content = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(F.col("page_id") % 6 == 1, F.concat(F.lit(" %PDF-"), "html")).otherwise(F.col("html")).cast("binary")
    return table(spark, d, "pages").groupBy((F.substring(content, 1, 5) == F.lit(b"%PDF-")).alias("is_pdf")).agg(F.count("*").alias("n"))


_AT = f"substr(d.text, ((h.chunk_id - 1) * {SIZE - OVERLAP} + 1)::BIGINT, {SIZE})"
_FLAT = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"
_CUT = lambda x, n, mark: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '{mark}' ELSE {x} END"
_SCORE = f"round(CASE WHEN type = 'PREFERENCE' THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(content), '{RECALL}') THEN 2 ELSE 0 END + ({' + '.join(f'CASE WHEN list_contains(words, {w!r}) THEN 1 ELSE 0 END' for w in RECALL.split())})::DOUBLE / 3 + greatest(0, 0.2::DOUBLE - updated * 6.0::DOUBLE / 240), 9)"
PUBLIC_RRF = f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS x, b.rank AS y, round(coalesce(1 / (60 + a.rank), 0.0) + coalesce(1 / (60 + b.rank), 0.0), 9) AS score
  FROM {bm25_ranked_sql('is_public', 5 * TOP)} a FULL JOIN {knn_sql(TOP, 'is_public')} b ON a.doc_id = b.doc_id AND a.chunk_id = b.chunk_id"""
CATALOG = {
    "generation_states": (generation_states, f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS st FROM events),
n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < {DAY_US} THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS g FROM n),
f AS (SELECT *, min(us) FILTER (WHERE st IS NOT NULL) OVER (PARTITION BY user_id, g) AS fus FROM s)
SELECT user_id, coalesce(arg_min(st, us) FILTER (WHERE st IS NOT NULL), 'STREAMING') AS status, count(*) FILTER (WHERE st IS NULL AND (fus IS NULL OR us <= fus)) AS chunks, min(us) AS began_us, coalesce(min(fus), max(us) + {DAY_US}) AS ended_us, max(us) + {DAY_US} AS expires_us FROM f GROUP BY user_id, g"""),
    "conversation_leases": (conversation_leases, f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), s AS (SELECT user_id, min(us) AS began FROM e GROUP BY user_id UNION ALL SELECT s.user_id, min(e.us) FROM s JOIN e ON e.user_id = s.user_id AND e.us >= s.began + {7 * DAY_US} GROUP BY s.user_id, s.began)
SELECT s.user_id, began AS began_us, count(*) AS events FROM s JOIN e ON e.user_id = s.user_id AND e.us >= began AND e.us < began + {7 * DAY_US} GROUP BY s.user_id, began"""),
    "upsert_files": (upsert_files, f"WITH f AS ({FILES_SQL}) SELECT doc_id, file_md5, total_size + CASE WHEN doc_id BETWEEN 100 AND 180 THEN 1 ELSE 0 END AS total_size FROM f WHERE doc_id >= 20 UNION ALL SELECT doc_id + 10000000, file_md5, total_size FROM f WHERE doc_id % 10 = 0"),
    "learned_words": (learned_words, """WITH r AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS r FROM documents), p AS (SELECT r, unnest(generate_series(1, length(r))) AS i FROM r), g AS (SELECT unnest([substr(r, i, 1), CASE WHEN i + 1 <= length(r) THEN substr(r, i, 2) END, CASE WHEN i + 2 <= length(r) THEN substr(r, i, 3) END]) AS word FROM p),
n AS (SELECT word, count(*) AS n FROM g WHERE word IS NOT NULL GROUP BY word), t AS (SELECT sum(n) AS total FROM n WHERE length(word) = 1), c AS (SELECT word, n, unnest(generate_series(1, length(word) - 1)) AS i FROM n WHERE length(word) > 1 AND n >= 50),
h AS (SELECT c.word, c.n, min(c.n * total::DOUBLE / (l.n::DOUBLE * q.n)) AS hold FROM c JOIN n l ON l.word = substr(c.word, 1, i) JOIN n q ON q.word = substr(c.word, i + 1), t GROUP BY c.word, c.n)
SELECT word, n FROM h WHERE hold >= 2 UNION ALL SELECT word, n FROM n WHERE length(word) = 1"""),
    "knowledge_stats_index": (knowledge_stats_index, f"""WITH c AS ({CHUNKS_SQL}), f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN DATE '2024-01-01' + (doc_id * 7919 % 1000)::INTEGER END AS merged, DATE '2024-01-01' + (doc_id % 500)::INTEGER AS created FROM documents)
SELECT count(*) AS documents, (SELECT count(*) FROM c WHERE user_id <> 3) AS fragments, (SELECT count(*) FROM c WHERE user_id = 3) AS deleted, (SELECT coalesce(merged, created) FROM f ORDER BY merged DESC NULLS LAST, doc_id DESC LIMIT 1) AS latest FROM f"""),
    "hybrid_search_public": (hybrid_search_public, f"SELECT * EXCLUDE (x, y, score), round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, x NULLS LAST, y NULLS LAST, doc_id, chunk_id)::INTEGER AS rank FROM ({PUBLIC_RRF})) WHERE rank <= {TOP}"),
    "hybrid_search_fallback": (hybrid_search_fallback, f"SELECT rank, doc_id, chunk_id, round(bm25, 6) AS bm25 FROM {bm25_ranked_sql(VISIBLE_SQL, TOP)}"),
    "reference_details": (reference_details, f"""WITH h AS (SELECT h.rank AS reference, md5(d.text) AS file_md5, source AS file_name, h.doc_id, h.chunk_id, round(h.score, 6) AS score, {_AT} AS content FROM ({RRF_SQL}) h JOIN documents d USING (doc_id) WHERE h.rank <= {TOP}),
a AS (SELECT *, {_FLAT.replace('x,', 'content,')} AS t FROM h), b AS (SELECT *, CASE WHEN doc_id % 4 = 0 AND length(t) > 0 THEN {_CUT('t', 120, '…')} END AS anchor_text, list_filter(list_transform(string_split(regexp_replace(content, '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 12)[1] AS one FROM a),
c AS (SELECT *, {_FLAT.replace('x,', 'coalesce(anchor_text, one, content),')} AS s FROM b)
SELECT reference, file_md5, file_name, NULL::INTEGER AS page_number, anchor_text, 'RRF' AS retrieval_mode, '{HYBRID_LABEL}' AS retrieval_label, '{' '.join(QUERY)}' AS retrieval_query, md5(content) AS matched_md5, {_CUT('s', 160, '…')} AS evidence, score, chunk_id FROM c"""),
    "summary_context": (summary_context, f"SELECT string_agg('[' || rank || '] ' || CASE WHEN length(trim(source)) > 0 THEN '文件：' || source || '，' ELSE '' END || 'fileMd5=' || md5(d.text) || '，chunkId=' || chunk_id || chr(10) || {_AT} || chr(10) || chr(10), '' ORDER BY rank) AS context FROM {bm25_ranked_sql(VISIBLE_SQL, 5)} h JOIN documents d ON d.doc_id = h.doc_id"),
    "memory_recall": (memory_recall, f"""WITH v AS (SELECT * FROM ({MEMORIES_SQL}) WHERE (scope = 'USER' AND user_id = 2) OR (scope = 'CONVERSATION' AND conversation_id = 3) ORDER BY updated DESC, id DESC LIMIT 200),
w AS (SELECT *, regexp_extract_all(lower(content), '[a-z0-9_-]{{2,}}') AS words FROM v), s AS (SELECT *, {_SCORE} AS score, {tokens_sql('content')} AS tokens FROM w), b AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 10)
SELECT * FROM (SELECT id, scope, round(score, 6) AS score, tokens, sum(tokens) OVER (ORDER BY score DESC, id DESC)::BIGINT AS total FROM b) WHERE total <= 400"""),
    "token_estimate_messages": (token_estimate_messages, f"""WITH m AS (SELECT *, CASE WHEN turn % 4 = 1 THEN '[{{"name":"search","turn":' || turn || '}}]' END AS calls, CASE WHEN turn % 2 = 0 THEN 'call_' || conv_id END AS id, CASE WHEN turn % 3 = 0 THEN role END AS why FROM conversations)
SELECT conv_id, sum(8 + {tokens_sql('role')} + {tokens_sql('text')} + {tokens_sql('why')} + {tokens_sql('calls')} + CASE WHEN turn % 4 = 3 THEN 128 ELSE 0 END + {tokens_sql('id')})::BIGINT AS tokens FROM m GROUP BY conv_id"""),
    "memory_entries": (memory_entries, f"WITH r AS (SELECT doc_id, ['user', 'assistant', 'tool', 'system'][(doc_id % 4 + 1)::BIGINT] AS role, {_FLAT.replace('x,', 'text,')} AS t FROM documents) SELECT doc_id, role, md5(CASE WHEN length(t) > m THEN substr(t, 1, m) || '...(已截断)' ELSE t END) AS entry_md5 FROM (SELECT *, CASE role WHEN 'user' THEN 1000 WHEN 'assistant' THEN 1200 ELSE 800 END AS m FROM r)"),
    "file_previews": (file_previews, f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), s AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l), k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS shown, max(upto) >= 10240 AS cut FROM s WHERE upto - strlen(line) - 1 < 10240 GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN doc_id % 5 <> 0 THEN shown || CASE WHEN cut THEN '{files.PREVIEW_CUT}' ELSE '' END ELSE printf('{files.NO_PREVIEW}', source || '.bin', CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' WHEN strlen(text) < 1048576 THEN printf('%.1f KB', strlen(text) / 1024.0::DOUBLE) ELSE printf('%.1f MB', strlen(text) / 1048576.0::DOUBLE) END, 'BIN', '2024-01-01') END) AS preview_md5 FROM k JOIN documents USING (doc_id)"""),
    "parent_chunks": (parent_chunks, f"""WITH b AS (SELECT doc_id, (i + 1)::INTEGER AS block, substr(text, (i * {PARENT} + 1)::BIGINT, {PARENT}) AS t FROM (SELECT doc_id, text, unnest(generate_series(0, ceil(length(text) / {PARENT}.0)::BIGINT - 1)) AS i FROM documents WHERE length(text) > 0)),
c AS (SELECT doc_id, block, i, substr(t, (i * {SIZE - OVERLAP} + 1)::BIGINT, {SIZE}) AS content FROM (SELECT *, unnest(generate_series(0, greatest(ceil((length(t) - {OVERLAP}) / {SIZE - OVERLAP}.0), 1)::BIGINT - 1)) AS i FROM b)) SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY block, i)::INTEGER AS chunk_id, md5(content) AS content_md5 FROM c"""),
    "quota_daily_usage": (quota_daily_usage, f"""WITH l AS (SELECT * FROM ({LEDGER_SQL}) WHERE user_id::BIGINT % 10 <> 0), s AS (SELECT ((SELECT max(record_date) FROM l) - i::INTEGER)::DATE AS record_date FROM (SELECT unnest(generate_series(0, 34)) AS i))
SELECT s.record_date, coalesce(sum(amount) FILTER (WHERE token_type = 'LLM' AND change_type = 'CONSUME'), 0)::BIGINT AS llm_tokens, count(*) FILTER (WHERE token_type = 'LLM' AND change_type = 'CONSUME') AS llm_requests, coalesce(sum(amount) FILTER (WHERE token_type = 'EMBEDDING' AND change_type = 'CONSUME'), 0)::BIGINT AS embedding_tokens, count(*) FILTER (WHERE token_type = 'EMBEDDING' AND change_type = 'CONSUME') AS embedding_requests, count(event_id) AS chats FROM s LEFT JOIN l USING (record_date) GROUP BY s.record_date"""),
    "usage_alerts_enabled": (usage_alerts_enabled, f"SELECT user_id, token_type, CASE WHEN user_id::BIGINT % 4 = 0 OR used <= 0 THEN NULL WHEN remaining = 0 THEN 'critical' WHEN used::DOUBLE / {LIMIT} >= 0.8 THEN 'warning' END AS level FROM ({SNAPSHOT_SQL})"),
    "day_ends": (day_ends, f"SELECT event_id, greatest((epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) // 1000000, 1) AS to_end, greatest((epoch_us(date_trunc('day', ts)) + {36 * DAY_US} - epoch_us(ts) - 1) // 1000000, 86400) AS kept FROM events"),
    "discounts": (discounts, "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 1000 END AS n FROM part) SELECT p_partkey, ceil(n / 10.0::DOUBLE - 0.5)::INTEGER AS percent, printf('%.1f', ceil(n / 10.0::DOUBLE - 0.5)::INTEGER / 10.0::DOUBLE) AS shown, coalesce(n > 0, false) AS legal FROM r"),
    "custom_recharge": (custom_recharge, "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS amount, round(o_totalprice * 100)::BIGINT * (SELECT floor(p_retailprice)::BIGINT FROM part WHERE p_size = 1 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 ORDER BY p_partkey LIMIT 1) AS tokens FROM orders"),
    "credited_orders": (credited_orders, "SELECT o_custkey AS user_id, sum(floor(o_totalprice)::BIGINT)::BIGINT AS tokens, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    "rate_limits_effective": (rate_limits_effective, "WITH p AS (SELECT p_brand, max(p_size) AS m, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand AS config_key, CASE WHEN m NOT IN (51, 50) THEN m ELSE 1 END::BIGINT AS single_max, CASE WHEN m NOT IN (51, 50) THEN n ELSE 2 END::BIGINT AS single_window_seconds, NULL::BIGINT AS minute_max, NULL::BIGINT AS minute_window_seconds, NULL::BIGINT AS day_max, NULL::BIGINT AS day_window_seconds FROM p"),
    "invite_verdicts": (invite_verdicts, """WITH r AS (SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 50 > 0 THEN 'C' || (o_custkey % 17) ELSE '' END AS code FROM orders), c AS (SELECT 'C' || s_suppkey AS code, s_suppkey AS k FROM supplier),
j AS (SELECT r.*, k, coalesce(k % 5 <> 0 AND k % 3 <> 0, false) AS usable FROM r LEFT JOIN c USING (code)), n AS (SELECT *, sum(usable::INTEGER) OVER (PARTITION BY code ORDER BY request_id) AS nth FROM j)
SELECT request_id, code, CASE WHEN code = '' THEN 'INVITE_CODE_REQUIRED' WHEN k IS NULL OR k % 5 = 0 THEN 'INVITE_CODE_INVALID' WHEN k % 3 = 0 THEN 'INVITE_CODE_EXPIRED' WHEN 1 + nth > k % 4 + 2 THEN 'INVITE_CODE_EXHAUSTED' ELSE 'OK' END AS verdict FROM n"""),
    "uploads_rejected": (uploads_rejected, "SELECT l_linenumber, count(*) FILTER (WHERE l_suppkey % 10 <> 0 AND l_partkey % 9 > 0 AND (trunc(l_extendedprice * 1000) > 20000000 OR (l_linenumber - 1) * 5242880 + trunc(l_quantity) * 100000 > 20000000)) AS rejected, count(*) AS parts FROM lineitem GROUP BY l_linenumber"),
    "assigned_tags": (assigned_tags, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'N1,R9' ELSE 'N1,PRIVATE_' || c_custkey || ',R9' END AS tags, CASE WHEN c_custkey % 5 = 0 THEN 'N7' WHEN c_custkey % 3 = 0 THEN 'N1' ELSE 'PRIVATE_' || c_custkey END AS primary_org FROM customer"),
    "files_without_tags": (files_without_tags, f"SELECT doc_id, user_id, is_public FROM ({FILES_SQL}) WHERE user_id = 7 OR is_public"),
    "parts_in_bitmap": (parts_in_bitmap, "WITH b AS (SELECT doc_id, md5(text) AS h, unnest(generate_series(0, 127)) AS part FROM documents), t AS (SELECT doc_id, part FROM b WHERE ((strpos('0123456789abcdef', substr(h, (part // 4 + 1)::BIGINT, 1)) - 1) >> (3 - part % 4)::INTEGER) & 1 = 1) SELECT doc_id, count(*) AS received, min(part)::INTEGER AS first, max(part)::INTEGER AS last FROM t GROUP BY doc_id"),
    "context_triggers": (context_triggers, "SELECT p_partkey, floor(greatest(p_size * 1000, 8000) * greatest(0.1::DOUBLE, least(0.98::DOUBLE, p_partkey % 100 / 80.0::DOUBLE)))::BIGINT AS trigger FROM part"),
    "conversations_between": (conversations_between, "SELECT count(*) AS all_users, count(*) FILTER (WHERE user_id = 7) AS one_user, min(event_id) AS first, max(event_id) AS last FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"),
    "json_failures": (json_failures, "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (props->>'k')::INTEGER END AS k, CASE WHEN event_id % 10 <> 0 THEN '{\"k\":' || (props->>'k') || '}' END AS told FROM events"),
    "pdf_magic": (pdf_magic, "SELECT page_id % 6 = 0 OR starts_with(html, '%PDF-') AND page_id % 6 <> 1 AS is_pdf, count(*) AS n FROM pages GROUP BY 1"),
}
