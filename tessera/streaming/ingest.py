"""Ingestion: files -> texts -> chunks, as batch and as a stream, with a dead-letter table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.chunking import fixed_chunks, smart_chunks
from tessera.sources.containers import ZIP_MAGIC, parse_container
from tessera.sources.pdf import PDF_MAGIC, parse_pdf

Parser = Callable[[str, bytes], list[tuple[int | None, str]]]
TEXT_KINDS = ("txt", "md", "csv", "json", "xml", "log")
HTML_KINDS = ("html", "htm")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "section", "article"):
            self.parts.append("\n\n" if tag in ("p", "div", "section", "article") else "\n")

    def handle_endtag(self, tag):
        self.hidden -= self.hidden > 0 and tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def parse(name: str, content: bytes) -> list[tuple[int | None, str]]:
    """[(page number or None, text)] of one file, by its content first; raises ValueError where it can't be read."""
    kind = name.rpartition(".")[2].lower()
    if content[:5] == PDF_MAGIC or kind == "pdf":
        return parse_pdf(content)
    if content[:4] == ZIP_MAGIC:
        return parse_container(content)
    if kind in HTML_KINDS:
        t = _Text()
        t.feed(content.decode("utf-8", "replace"))
        return [(None, "".join(t.parts).strip())]
    if kind in TEXT_KINDS or "." not in name:
        return [(None, content.decode("utf-8"))]
    raise ValueError(f"unsupported type: {kind}")


def read_files(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """path and content of the files below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream if stream else spark.read
    return reader.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def chunk_rows(md5: str, path: str, content: bytes, parser: Parser, cut: Callable[[str, int], list[str]], size: int) -> list[tuple]:
    """(file_md5, path, chunk_id, page_number, content, error) of one file: its chunks, or one row with what the parser threw."""
    try:
        pages = parser(path.rpartition("/")[2], content)
    except Exception as e:  # whatever a parser throws goes to the dead letters
        return [(md5, path, None, None, None, f"{type(e).__name__}: {e}")]
    rows = []
    for page, text in pages:
        rows += [(md5, path, len(rows) + i + 1, page, c, None) for i, c in enumerate(cut(text, size) if text.strip() else [])]
    return rows


def chunk_files(files: DataFrame, parser: Parser = parse, strategy: str = "fixed", size: int = 512) -> DataFrame:
    """file_md5, path, chunk_id (from 1, running over pages), page_number, content, error: one row with the error where parsing
    failed, else one for each chunk. Keys are hashes of the content, so a second run gives the same rows. One try: a parser that
    fails on some bytes fails on them again; streaming.retry tries files again that may yet come right."""
    cut = {"fixed": fixed_chunks, "smart": smart_chunks}[strategy]
    columns = ["file_md5", "path", "chunk_id", "page_number", "content", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for md5, path, content in zip(b["file_md5"], b["path"], b["content"], strict=True) for r in chunk_rows(md5, path, bytes(content), parser, cut, size)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"chunk_id": "Int32", "page_number": "Int32"})

    return files.select(F.md5("content").alias("file_md5"), "path", "content").mapInPandas(run, "file_md5 string, path string, chunk_id int, page_number int, content string, error string")


def ingest_stream(files: DataFrame, chunks_path: str, dead_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Chunks and dead letters of a stream of files; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = chunk_files(batch, **options).persist()
        rows.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")
        rows.where("error IS NOT NULL").select("file_md5", "path", "error", F.lit(1).alias("attempts")).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        rows.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 10, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """chunks with `vector`: the injected model gets `batch` texts a call and is called again, `wait` seconds after an error."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", vector array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, vectors = b["content"].tolist(), []
            for i in range(0, len(texts), batch):
                for left in reversed(range(retries + 1)):
                    try:
                        vectors += model(texts[i : i + batch])
                        break
                    except ConnectionError:
                        if not left:
                            raise
                        time.sleep(wait)
            yield b.assign(vector=vectors)

    return chunks.mapInPandas(run, schema)
