"""One query for each operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie: a function from file name to path; replaceable.
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_index import read_tokens, write_tokens

    docs = table(spark, sf_dir, "documents")
    files = write_tokens(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_tokens(files, docs.select("doc_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def _crc_of_id():
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    held_out = _crc_of_id() % 4 == 2
    model = learn(docs.where(~held_out))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontam import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), shards=40, tolerance=0.01)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    held_out = _crc_of_id() % 5 == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = score(docs.select("doc_id", "text"), model, threshold=0.3)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=8)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.impact_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_index": op1_token_index,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_sharding": op8_sharding,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_mixing": op13_mixing,
}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORDS = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d)"""
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_REACH = """m AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)"""

SQL: dict[str, str] = {
    "op6_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
c AS (SELECT line_key, max(doc_id) AS last FROM k WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c ON k.line_key = c.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op2_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
      WHERE CASE WHEN isnan(list_cosine_similarity(x.e, y.e)) THEN false ELSE list_cosine_similarity(x.e, y.e) >= 0.98 END),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM m WHERE m.a = vec_id) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id
""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE {_WORDS.format(text=_ASCII_LOWER)},
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER v AS size, string_agg(word, ' ') OVER v AS t FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, t FROM g WHERE size = 3 OR (n < 3 AND pos = 1)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE 100 * shared >= 90 * (ka.n + kb.n - shared)),
{_REACH}
SELECT doc_id, coalesce(k.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.a = doc_id
""",
    "op10_substring_dedup": f"""
WITH {_WORDS.format(text="text")},
g AS (SELECT doc_id, pos, count(*) OVER v AS size, string_agg(word, ' ') OVER v AS t FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT t, min(doc_id) AS first FROM g WHERE size = 13 GROUP BY t),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM (SELECT g.doc_id, g.pos, unnest(generate_series(0, 12)) AS j FROM g JOIN f ON f.t = g.t WHERE g.size = 13 AND f.first < g.doc_id)),
k AS (SELECT w.doc_id, count(*) AS n, count(gone.pos) AS lost, string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE gone.pos IS NULL) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos GROUP BY w.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
""",
    "op12_ranked_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '{_TERMS}') AS ts FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS all_terms FROM d WHERE len(ts) > 0),
m AS (SELECT doc_id, 75 + (25 * len(ts) * n_docs) // all_terms AS m FROM d, s WHERE len(ts) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '{_TERMS}')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
h AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM h WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
""",
}
