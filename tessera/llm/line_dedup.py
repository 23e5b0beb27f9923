"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, WHITE, prepare, written


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """All columns of docs, with `text` rewritten, plus `n_lines` (before dropping) and `n_dropped`.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    `min_chars` code points found in at least `min_docs` documents lose all their lines except those of the
    largest doc_id that holds the key. Other lines stay, in order, joined by newline.

    Null or empty text: one empty line, which stays; the text becomes ''. A document that loses every line:
    ''. Null doc_id: counts as one document, smaller than all others. Rows that repeat a doc_id are one document
    for counting and are each rewritten. Extra columns pass through; n_lines and n_dropped replace
    columns of those names. An empty table gives an empty table.

    Two passes over the texts, JVM only. The first explodes the lines with their positions and keeps those that are long enough,
    as hashes; their counts are combined before each shuffle, so a line that a third of all documents share is a few rows
    for each task. The second shuffles the texts once, by document and text, and puts each together from the positions that stay.
    """
    prepare(docs.sparkSession)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    hashes = F.transform(F.transform(lines, line_key), lambda k: F.when(F.char_length(k) >= min_chars, _hash(k)))
    row = {"__d": F.col("doc_id").cast("long"), "__t": F.xxhash64("text")}  # rows that repeat a doc_id may have other texts
    seen = written(docs.select(*(c.alias(n) for n, c in row.items()), F.posexplode(hashes).alias("pos", "h")).where("h is not null"), "lines")
    common = seen.select("__d", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("last")).where(F.col("n") >= min_docs)
    lost = seen.join(common, "h").where(~F.col("__d").eqNullSafe(F.col("last"))).groupBy(F.col("__d").alias("__ld"), F.col("__t").alias("__lt")).agg(F.collect_set("pos").alias("__lost"))
    out = docs.drop("n_lines", "n_dropped").withColumns(row).join(lost, F.col("__d").eqNullSafe(F.col("__ld")) & (F.col("__t") == F.col("__lt")), "left")
    # the lines are bound as x, so that a text is split once and not for each position
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["lost"])
    whole = F.transform(F.array(F.struct(lines.alias("lines"), F.col("__lost").alias("lost"))), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x["lines"], i)), "\n"))
    text = F.when(F.col("__lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(whole, 0))
    new = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long"), "text": text}
    return out.withColumns(new).drop("__d", "__t", "__ld", "__lt", "__lost")
