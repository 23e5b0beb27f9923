"""Uploaded files: parts, merging, reconciliation, boilerplate lines, previews, statistics, replacement."""

from __future__ import annotations

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import boundary_key, human_size, nfkc

PART_BYTES = 5 * 1024 * 1024
PREVIEW_BYTES = 10_240


def parts_expected(size: Column) -> Column:
    return F.ceil(size / F.lit(PART_BYTES)).cast("long")


def progress(files: DataFrame, parts: DataFrame) -> DataFrame:
    """uploaded, expected and percent of each file; 0 percent where nothing is expected."""
    got = parts.groupBy("file_id").agg(F.countDistinct("part").alias("uploaded"))
    out = files.join(got, "file_id", "left").select("file_id", F.coalesce("uploaded", F.lit(0)).alias("uploaded"), parts_expected(F.col("total_size")).alias("expected"))
    return out.withColumn("percent", F.when(F.col("expected") == 0, F.lit(0.0)).otherwise(F.round(F.col("uploaded") * 100.0 / F.col("expected"), 6)))


def missing_parts(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts, from 0, that have not arrived."""
    n = parts_expected(F.col("total_size"))
    want = files.where(n > 0).select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"))
    return want.join(parts.select("file_id", F.col("part").cast("long").alias("part")).distinct(), ["file_id", "part"], "left_anti")


def accept_parts(received: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming parts (file_id, part, content, seq) that are stored, with chunk_md5: the first of each that isn't there yet."""
    new = incoming.join(received.select("file_id", "part").distinct(), ["file_id", "part"], "left_anti")
    return keep_first(new, ["file_id", "part"], [F.asc("seq")]).withColumn("chunk_md5", F.md5("content")).drop("seq")


def merge_parts(parts: DataFrame, expected: DataFrame, folder: str) -> DataFrame:
    """file_id, path and bytes of files whose parts are all there, each composed in order of part in a file below `folder`
    (parts: file_id, part, content; expected: file_id, expected).

    A part is held at a time, so files may be larger than memory. A file is named by the task attempt that wrote it; of repeated
    attempts, the one whose row is returned counts.
    """
    once = parts.dropDuplicates(["file_id", "part"])
    whole = once.groupBy("file_id").agg(F.count("*").alias("n")).join(expected, "file_id").where("n = expected").select("file_id")
    rows = once.join(whole, "file_id").select("file_id", "part", "content").repartition("file_id").sortWithinPartitions("file_id", "part")
    kind = rows.schema["file_id"].dataType.simpleString()

    def compose(batches):
        attempt, now, out, path, size = TaskContext.get().taskAttemptId(), None, None, "", 0
        for b in batches:
            for own, content in zip(b["file_id"], b["content"], strict=True):
                if out is None or own != now:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame({"file_id": [now], "path": [path], "bytes": [size]})
                    now, path, size = own, f"{folder.rstrip('/')}/{own}-{attempt}", 0
                    at, place = fs.FileSystem.from_uri(path)
                    at.create_dir(place.rpartition("/")[0], recursive=True)
                    out = at.open_output_stream(place)
                out.write(bytes(content))
                size += len(content)
        if out is not None:
            out.close()
            yield pd.DataFrame({"file_id": [now], "path": [path], "bytes": [size]})

    return rows.mapInPandas(compose, f"file_id {kind}, path string, bytes long")


def stale_versions(files_: DataFrame) -> DataFrame:
    """file_name, file_md5 of contents that a later upload of the same owner and name (by id) has replaced."""
    latest = files_.groupBy("owner", "file_name").agg(F.max_by("file_md5", "id").alias("current"))
    return files_.join(latest, ["owner", "file_name"]).where("file_md5 <> current").select("owner", "file_name", "file_md5").distinct()


def ready(files_: DataFrame, chunks: DataFrame, indexed: DataFrame, parts: DataFrame, owner: int, org_tag: str) -> DataFrame:
    """file_md5, ready: whether a file is complete in every store, with this owner and tag: chunks and index entries are there
    and as many as each other, and so are parts."""
    count = lambda df, name: df.groupBy("file_md5").agg(F.count("*").alias(name))
    both = files_.join(count(chunks, "c"), "file_md5", "left").join(count(indexed, "i"), "file_md5", "left").join(count(parts, "p"), "file_md5", "left")
    whole = (F.col("status") == 1) & (F.col("c") > 0) & (F.col("c") == F.col("i")) & (F.col("p") > 0) & (F.col("user_id") == owner) & (F.col("org_tag") == org_tag)
    return both.select("file_md5", F.coalesce(whole, F.lit(False)).alias("ready"))


def reconcile(completed: DataFrame, indexed: DataFrame, stored: DataFrame, key: str = "file_md5") -> DataFrame:
    """How many completed files are in the index, the vector store, both or neither."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = completed.select(key).distinct().join(mark(indexed, "i"), key, "left").join(mark(stored, "v"), key, "left")
    state = F.when(F.col("i") & F.col("v"), "NORMAL").when(F.col("i"), "ES_ONLY").when(F.col("v"), "VECTOR_ONLY").otherwise("BOTH_MISSING")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("files"))


def _boundaries(pages: DataFrame, file: str, page: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(file, page, side, rank, pos, key of the first and the last `depth` lines that aren't blank; keys that enough pages share)."""
    solid = F.filter(F.transform(page_lines(F.col("text")), lambda line, i: F.struct(i.alias("pos"), line.alias("line"))), lambda x: F.length(x["line"]) > 0)
    placed = lambda side, lines: F.transform(lines, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("rank"), x["pos"].alias("pos"), x["line"].alias("line")))
    ends = lambda s: F.concat(placed("top", F.slice(s, 1, depth)), placed("bottom", F.slice(F.reverse(s), 1, depth)))
    # a text is split once: its lines are bound to a name, and what is taken from them is exploded before anything else
    near = pages.select(file, page, F.explode(F.get(F.transform(F.array(solid), ends), 0)).alias("x")).select(file, page, "x.side", "x.rank", "x.pos", "x.line")
    both = near.withColumn("key", boundary_key(nfkc(F.col("line")))).drop("line")
    counts = both.where("key is not null").groupBy(file, "side", "key").agg(F.count("*").alias("pages"))
    total = pages.groupBy(file).agg(F.countDistinct(page).alias("n"))
    return both, counts.join(total, file).where(F.col("pages") >= F.greatest(F.lit(2), F.least(F.lit(3), F.col("n")))).drop("n")


def page_lines(text: Column) -> Column:
    """The lines of a page, without blanks at their ends."""
    return F.transform(F.split(text, r"\r\n|[\n\r]", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f")))


def boundary_lines(pages: DataFrame, file: str, page: str, depth: int = 3) -> DataFrame:
    """file, side, key and pages: lines that stand among the first or last `depth` ones, blank ones aside, of enough pages."""
    return _boundaries(pages, file, page, depth)[1]


def strip_boundaries(pages: DataFrame, file: str, page: str, depth: int = 3) -> DataFrame:
    """pages with `text` freed of repeated headers and footers: from either end up to `depth` lines go, as long as each is one that
    enough pages share; blank lines between them go too."""
    both, shared = _boundaries(pages, file, page, depth)
    marked = both.join(shared.select(file, "side", "key", F.lit(1).alias("hit")), [file, "side", "key"], "left")
    upto = Window.partitionBy(file, page, "side").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.withColumn("all", F.min(F.coalesce("hit", F.lit(0))).over(upto)).where("all = 1")
    cuts = run.groupBy(file, page).agg(F.max(F.when(F.col("side") == "top", F.col("pos"))).alias("__top"), F.min(F.when(F.col("side") == "bottom", F.col("pos"))).alias("__bottom"))
    lines = page_lines(F.col("text"))
    start = F.coalesce(F.col("__top") + 1, F.lit(0))
    end = F.coalesce("__bottom", F.size(lines))
    kept = F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))
    text = F.btrim(F.array_join(kept, "\n"), F.lit(" \t\n\x0b\f\r"))
    return pages.join(cuts, [file, page], "left").withColumn("text", text).select(*pages.columns)


def preview(text: Column, limit: int = PREVIEW_BYTES) -> Column:
    """(lines, text): whole lines as long as those before hold fewer bytes than the limit."""
    zero = F.struct(F.lit(0).alias("bytes"), F.array().cast("array<string>").alias("kept"))

    def step(s, line):
        more = F.struct((s["bytes"] + F.octet_length(line) + 1).alias("bytes"), F.concat(s["kept"], F.array(line)).alias("kept"))
        return F.when(s["bytes"] < limit, more).otherwise(s)

    # a line counts one byte at least, so no more lines than bytes can be kept
    return F.aggregate(F.slice(F.split(text, "\n", -1), 1, limit), zero, step)["kept"]


# Fixed texts: the mark of a cut preview, and what is shown of a file without text.
PREVIEW_CUT = "\n... (内容已截断，仅显示前10KB)"
NO_PREVIEW = "文件名: %s\n文件大小: %s\n文件类型: %s\n上传时间: %s\n\n此文件类型不支持预览，请下载后查看。"


def file_preview(name: Column, is_text: Column, text: Column, size: Column, created: Column) -> Column:
    """What is shown of a file: the whole lines of preview(), each with its line feed, marked where the limit was reached; of a file
    without text its name, size, type and date."""
    kept = preview(text)
    shown = F.concat(F.array_join(kept, "\n"), F.lit("\n"))
    cut = F.when(F.octet_length(shown) >= PREVIEW_BYTES, F.lit(PREVIEW_CUT)).otherwise("")
    kind = F.upper(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(is_text, F.concat(shown, cut)).otherwise(F.format_string(NO_PREVIEW, name, human_size(size, half_even=True), kind, created))


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def replace(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert as a rewrite: rows without the new ones' keys, and the new rows."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def html_text(html: Column) -> Column:
    """Readable text of a page: without scripts, styles, comments and tags, common entities resolved, spaces collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
