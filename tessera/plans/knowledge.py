"""Token, file, page and conversation queries: name -> (query, SQL of the same rows or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.operators import files, memory
from tessera.plans.search import CHUNKS_SQL, FILES_SQL, chunks
from tessera.sources import tables
from tessera.sources.tables import table

RECALL = "inst the of"

# Extensions by kind, and those whose text can and can't be read.
PREVIEW_KINDS = {"pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "gif", "bmp", "webp", "svg"], "text": ["txt", "md", "csv", "json", "xml", "html", "htm", "log", "yaml", "yml"]}

SUPPORTED = "pdf doc docx xls xlsx ppt pptx txt rtf md odt ods odp html htm xml json csv epub pages numbers keynote".split()
UNSUPPORTED = "jpg jpeg png gif bmp svg webp tiff ico psd mp3 wav flac aac ogg wma m4a mp4 avi mov wmv flv mkv webm m4v 3gp zip rar 7z tar gz bz2 xz exe msi dmg pkg deb rpm ttf otf woff woff2 eot dwg dxf step iges db sqlite mdb accdb bin dat iso img".split()


def tokens_sql(t: str) -> str:
    """The token estimate, for texts without CJK or wide characters beside counted CJK ones."""
    s = f"regexp_replace(coalesce({t}, ''), '\\s', '', 'g')"
    ascii_, cjk = f"len(regexp_extract_all({s}, '[\\x00-\\x7F]'))", f"len(regexp_extract_all({s}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]'))"
    return f"CASE WHEN length({s}) = 0 THEN 0 ELSE greatest(1, ceil({ascii_} * 0.30::DOUBLE + {cjk} * 0.95::DOUBLE + (length({s}) - {ascii_} - {cjk}) * 0.55::DOUBLE + 12.0::DOUBLE))::BIGINT END"


def token_estimate_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


def token_estimate_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and embedding tokens of each file: the estimate before anything is written."""
    per = chunks(spark, d).select("doc_id", tx.estimate_tokens(F.col("content")).alias("t"))
    return per.groupBy("doc_id").agg(F.count("*").alias("chunks"), tx.estimate_embedding_tokens(F.sum(F.col("t") + 4)).alias("tokens"))


def token_estimate_chat(spark: SparkSession, d: str) -> DataFrame:
    per = tables.messages(spark, d).select("conv_id", memory.message_tokens(F.col("role"), F.col("text")).alias("t"))
    return per.groupBy("conv_id").agg(F.sum("t").alias("tokens"))


def html_text_extract(spark: SparkSession, d: str) -> DataFrame:
    t = files.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n"), F.md5(t).alias("text_md5"))


def extension(url):
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def file_type_classify(spark: SparkSession, d: str) -> DataFrame:
    """Extension, support and preview type of the pages' addresses, and of the same ones as files of several kinds."""
    kinds = ["pdf", "png", "txt", "md", "docx", "exe", "html"]
    pages = table(spark, d, "pages")
    names = pages.select("url").union(pages.select(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/file."), F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 7 + 1).cast("int")), F.lit("?v=1"))))
    ext = extension(F.regexp_extract("url", r"://[^/]*(/.*)$", 1))
    kind = F.when(ext.isin(*PREVIEW_KINDS["pdf"]), "pdf").when(ext.isin(*PREVIEW_KINDS["image"]), "image").when(ext.isin(*PREVIEW_KINDS["text"]), "text").otherwise("download")
    state = F.when(ext.isin(*SUPPORTED), "supported").when(ext.isin(*UNSUPPORTED), "unsupported").otherwise("unknown")
    return names.groupBy(ext.alias("ext"), kind.alias("kind"), state.alias("state")).agg(F.count("*").alias("n"))


def preview_10kb(spark: SparkSession, d: str) -> DataFrame:
    kept = files.preview(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(kept).alias("lines"), F.md5(F.array_join(kept, "\n")).alias("preview_md5"))


def memory_tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = F.array_sort(tx.memory_tokens(F.col("text")))
    return tables.messages(spark, d).select("conv_id", "turn", "role", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


def _memories(spark: SparkSession, d: str) -> DataFrame:
    score = memory.recall_score(F.col("text"), F.col("turn") % 5 == 0, F.col("turn") * 6.0, RECALL, RECALL.split())
    rows = tables.messages(spark, d).where("role = 'user'").withColumn("score", F.round(score, 9)).where("score > 0")
    return rows.withColumn("tokens", tx.estimate_tokens(F.col("text")))


def memory_score_topk(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    return _memories(spark, d).withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("conv_id", "turn", "rank", F.round("score", 6).alias("score"))


def memory_context_budget(spark: SparkSession, d: str) -> DataFrame:
    _, long_term = memory.budget_shares(1200)
    return memory.within_budget(_memories(spark, d), "conv_id", [F.desc("score"), F.asc("turn")], "tokens", long_term).select("conv_id", "turn", "tokens", "total")


def _history(n: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        text = tx.truncate(F.col("text"), 800, "…")
        return memory.last_messages(tables.messages(spark, d), n).select("conv_id", "pos", "turn", "role", F.md5(text).alias("text_md5"))

    return query


def runtime_context_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.messages(spark, d).withColumn("tokens", memory.message_tokens(F.col("role"), F.col("text")))
    runtime, _ = memory.budget_shares(600)
    return memory.within_budget(rows, "conv_id", [F.desc("turn"), F.asc("role")], "tokens", runtime).select("conv_id", "turn", "role", "tokens", "total")


def compaction_split(spark: SparkSession, d: str) -> DataFrame:
    return memory.split_for_compaction(tables.messages(spark, d), 2).select("conv_id", "turn", "role", "summarise")


def compaction_map_chunks(spark: SparkSession, d: str) -> DataFrame:
    return memory.numbered_groups(tables.messages(spark, d), 5).select("conv_id", "group", "n", F.md5("text").alias("text_md5"))


def compaction_summaries(spark: SparkSession, d: str) -> DataFrame:
    """With a stand-in for the summariser: the first words of each text."""
    return memory.compact(tables.messages(spark, d), lambda texts: " / ".join(" ".join(t.split()[:5]) for t in texts), 5, 1)


def turn_to_messages(spark: SparkSession, d: str) -> DataFrame:
    return memory.turn_messages(memory.turns(tables.messages(spark, d))).select("conv_id", "turn", "pos", "role", F.md5("text").alias("text_md5"))


def reconcile_states(spark: SparkSession, d: str) -> DataFrame:
    f = tables.files(spark, d)
    stored = f.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return files.reconcile(f, f.where("is_public OR user_id > 20"), stored)


def knowledge_stats(spark: SparkSession, d: str) -> DataFrame:
    f = tables.files(spark, d).agg(F.countDistinct("file_md5").alias("documents"), F.sum("total_size").alias("bytes"), F.max_by("file_name", "doc_id").alias("latest"))
    c = chunks(spark, d).agg(F.count("*").alias("fragments"))
    return f.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").drop("one")


def dedupe_md5(spark: SparkSession, d: str) -> DataFrame:
    f = tables.files(spark, d)
    return f.groupBy("file_md5").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def delete_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Files of one source are indexed anew under a new name; the others stay."""
    f = tables.files(spark, d).select("doc_id", "file_md5", "file_name")
    new = f.where("file_name = 'src3'").withColumn("file_name", F.lit("src3-v2"))
    return files.replace(f, new, "file_md5")


def tag_slugs(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", F.concat_ws(" / ", "p_brand", "p_size").alias("name"))
    return tx.unique_slugs(named, "name", "p_partkey").select("p_partkey", "tag_id")


def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tables.files(spark, d).select("doc_id", tx.human_size(F.col("total_size") * F.col("doc_id")).alias("size"))


MSG_SQL = f"SELECT *, (8 + {tokens_sql('role')} + {tokens_sql('text')})::BIGINT AS tokens FROM conversations"
WORDS_SQL = "list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]{2,}')))"
MEMORY_SQL = f"""SELECT conv_id, turn, {tokens_sql('text')} AS tokens, round(CASE WHEN turn % 5 = 0 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(text), '{RECALL}') THEN 2 ELSE 0 END
  + len(list_intersect({WORDS_SQL}, ['inst', 'the', 'of'])) / 3.0::DOUBLE + greatest(0.0::DOUBLE, 0.2::DOUBLE - turn * 6 / 240.0::DOUBLE), 9) AS score FROM conversations WHERE role = 'user'"""


def _history_sql(n: int) -> str:
    return f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS back FROM conversations) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY back DESC)::INTEGER AS pos, turn, role,
      md5(CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '…' ELSE text END) AS text_md5 FROM b WHERE back <= {n}"""


CATALOG = {
    "token_estimate_docs": (token_estimate_docs, f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents"),
    "token_estimate_embedding": (token_estimate_embedding, f"SELECT doc_id, count(*) AS chunks, ceil(sum(t + 4) * 1.15::DOUBLE)::BIGINT AS tokens FROM (SELECT doc_id, {tokens_sql('content')} AS t FROM ({CHUNKS_SQL})) GROUP BY doc_id"),
    "token_estimate_chat": (token_estimate_chat, f"SELECT conv_id, sum(tokens)::BIGINT AS tokens FROM ({MSG_SQL}) GROUP BY conv_id"),
    "html_text_extract": (html_text_extract, r"""SELECT page_id, length(t)::INTEGER AS n, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)"""),
    "file_type_classify": (file_type_classify, r"""WITH u AS (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '[?#].*$', '') || '/file.' || ['pdf', 'png', 'txt', 'md', 'docx', 'exe', 'html'][page_id % 7 + 1] || '?v=1' FROM pages), e AS (SELECT lower(regexp_extract(regexp_replace(regexp_extract(url, '://[^/]*(/.*)$', 1), '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1)) AS ext FROM u) SELECT ext, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'png' THEN 'image' WHEN ext IN ('txt', 'md', 'html') THEN 'text' ELSE 'download' END AS kind, CASE WHEN ext IN ('pdf', 'txt', 'md', 'docx', 'html') THEN 'supported' WHEN ext IN ('png', 'exe') THEN 'unsupported' ELSE 'unknown' END AS state, count(*) AS n FROM e GROUP BY ALL"""),
    "preview_10kb": (preview_10kb, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), s AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT doc_id, count(*)::INTEGER AS lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS preview_md5 FROM s WHERE before < 10240 GROUP BY doc_id"),
    "memory_tokenize": (memory_tokenize, f"SELECT conv_id, turn, role, len({WORDS_SQL})::INTEGER AS n, array_to_string({WORDS_SQL}, ' ') AS tokens FROM conversations"),
    "memory_score_topk": (memory_score_topk, f"SELECT conv_id, turn, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn)::INTEGER AS rank FROM ({MEMORY_SQL}) WHERE score > 0) WHERE rank <= 10"),
    "memory_context_budget": (memory_context_budget, f"SELECT * FROM (SELECT conv_id, turn, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY score DESC, turn)::BIGINT AS total FROM ({MEMORY_SQL}) WHERE score > 0) WHERE total <= 600"),
    "history_last20": (_history(20), _history_sql(20)),
    "react_history_last6": (_history(6), _history_sql(6)),
    "runtime_context_budget": (runtime_context_budget, f"SELECT * FROM (SELECT conv_id, turn, role, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC, role)::BIGINT AS total FROM ({MSG_SQL})) WHERE total <= 300"),
    "compaction_split": (compaction_split, "SELECT conv_id, turn, role, coalesce(sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 AS summarise FROM conversations"),
    "compaction_map_chunks": (compaction_map_chunks, "SELECT conv_id, \"group\", count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM (SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5)::INTEGER AS \"group\" FROM conversations) GROUP BY ALL"),
    "compaction_summaries": (compaction_summaries, None),
    "turn_to_messages": (turn_to_messages, "WITH t AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant') SELECT conv_id, turn, 0 AS pos, 'user' AS role, md5(question) AS text_md5 FROM t UNION ALL SELECT conv_id, turn, 1, 'assistant', md5(answer) FROM t"),
    "reconcile_states": (reconcile_states, f"WITH f AS ({FILES_SQL}), c AS (SELECT file_md5, bool_or(is_public OR user_id > 20) AS i, bool_or(doc_id IN (SELECT vec_id FROM embeddings)) AS v FROM f GROUP BY file_md5) SELECT CASE WHEN i AND v THEN 'NORMAL' WHEN i THEN 'ES_ONLY' WHEN v THEN 'VECTOR_ONLY' ELSE 'BOTH_MISSING' END AS state, count(*) AS files FROM c GROUP BY ALL"),
    "knowledge_stats": (knowledge_stats, f"WITH f AS ({FILES_SQL}) SELECT (SELECT count(DISTINCT file_md5) FROM f) AS documents, (SELECT sum(total_size)::BIGINT FROM f) AS bytes, (SELECT arg_max(file_name, doc_id) FROM f) AS latest, (SELECT count(*) FROM ({CHUNKS_SQL})) AS fragments"),
    "dedupe_md5": (dedupe_md5, f"SELECT file_md5, min(doc_id) AS first_doc, count(*) AS copies FROM ({FILES_SQL}) GROUP BY file_md5"),
    "delete_reindex": (delete_reindex, f"WITH f AS ({FILES_SQL}) SELECT doc_id, file_md5, file_name FROM f WHERE file_md5 NOT IN (SELECT file_md5 FROM f WHERE file_name = 'src3') UNION ALL SELECT doc_id, file_md5, 'src3-v2' FROM f WHERE file_name = 'src3'"),
    "tag_slugs": (tag_slugs, r"WITH s AS (SELECT p_partkey, 'ORG_' || regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_size), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS r FROM s) SELECT p_partkey, CASE WHEN r = 1 THEN slug ELSE slug || '_' || r END AS tag_id FROM n"),
    "file_sizes": (file_sizes, f"SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', floor(s / 1024.0 * 10 + 0.5) / 10) WHEN s < 1073741824 THEN printf('%.1f MB', floor(s / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(s / 1073741824.0 * 10 + 0.5) / 10) END AS size FROM (SELECT doc_id, total_size * doc_id AS s FROM ({FILES_SQL}))"),
}
