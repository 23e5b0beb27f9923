"""Tasks of a stream that are tried again after a wait, each attempt counted in state, and dead letters after the last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessera.operators import keyed_table
from tessera.operators.chunking import fixed_chunks, smart_chunks
from tessera.streaming.ingest import Parser, chunk_rows, parse

#: The first try and four more, three seconds apart.
ATTEMPTS, WAIT_MS = 5, 3000
#: Timers and state with a time to live need this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "file_md5 string, path string, chunk_id int, page_number int, content string, error string, attempts int, tried_ms long"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class Retrying(StatefulProcessor):
    """A file's state, while it fails: path, content and the attempts so far. A timer brings the next one."""

    def __init__(self, parser: Parser, cut: Callable[[str, int], list[str]], size: int, attempts: int, wait_ms: int) -> None:
        self.parser, self.cut, self.size, self.attempts, self.wait_ms = parser, cut, size, attempts, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.failing = handle.getValueState("failing", "path string, content binary, attempts int")

    def _try(self, md5: str, path: str, content: bytes, attempt: int, now: int) -> pd.DataFrame:
        rows = chunk_rows(md5, path, content, self.parser, self.cut, self.size)
        failed = bool(rows) and rows[0][-1] is not None
        if failed and attempt < self.attempts:
            self.failing.update((path, content, attempt))
            self.handle.registerTimer(now + self.wait_ms)
            rows = []
        elif self.failing.exists():
            self.failing.clear()
        out = pd.DataFrame([(*r, attempt, now) for r in rows], columns=COLUMNS)
        return out.astype({"chunk_id": "Int32", "page_number": "Int32", "attempts": "int32", "tried_ms": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = next(iter(rows), None)
        for _ in rows:  # equal content that came with it is one task
            pass
        if first is not None and len(first) and not self.failing.exists():
            yield self._try(key[0], first["path"].iloc[0], bytes(first["content"].iloc[0]), 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.failing.exists():
            path, content, tried = self.failing.get()
            yield self._try(key[0], path, bytes(content), tried + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def chunks_with_retries(files: DataFrame, parser: Parser = parse, strategy: str = "fixed", size: int = 512, attempts: int = ATTEMPTS, wait_ms: int = WAIT_MS) -> DataFrame:
    """The rows of ingest.chunk_files for a stream of (path, content), with `attempts` and the time of the last one.

    A file that fails is held in state and tried again by a timer, wait_ms after the try before; nothing else waits for it. After
    the last attempt one row with the error comes out. Files are told apart by their content's hash: one that comes again while it
    is being retried starts nothing new. The session needs the state store STORE names, and a trigger that goes on, as
    timers fire in a later micro-batch.
    """
    cut = {"fixed": fixed_chunks, "smart": smart_chunks}[strategy]
    rows = files.select(F.md5("content").alias("file_md5"), "path", "content")
    return rows.groupBy("file_md5").transformWithStateInPandas(Retrying(parser, cut, size, attempts, wait_ms), OUTPUT, "append", "ProcessingTime")


def publish_once(tasks: DataFrame, ledger: str, key: str) -> DataFrame:
    """Those tasks whose key was never published below `ledger`, one for each key; they are published when this returns.

    The ledger is a keyed table, so a batch rewrites no file but those that its keys lie in, and a version of it takes effect as a
    whole: a run that breaks off has published all of its tasks or none. What a second run of the same tasks returns is
    what the first one published, as long as nothing was published in between; so a micro-batch may be repeated.
    """
    spark = tasks.sparkSession
    # the batch is known by its rows, whatever their order and number of copies
    n, mark = tasks.distinct().agg(F.count("*"), F.sum(F.xxhash64(*sorted(tasks.columns)).cast("decimal(38,0)"))).first()
    rows = tasks.withColumn("__batch", F.lit(f"{n}:{mark}"))
    if keyed_table._files(spark, ledger)[2] is None:
        keyed_table.create(rows.limit(0), ledger, key)
    known = keyed_table.read(spark, ledger)
    keyed_table.upsert(rows.join(known.select(key), key, "left_anti"), ledger)
    return keyed_table.read(spark, ledger).where(F.col("__batch") == f"{n}:{mark}").drop("__batch")


def ingest_with_retries(files: DataFrame, chunks_path: str, dead_path: str, checkpoint: str, trigger: str = "1 second", **options) -> StreamingQuery:
    """Chunks and dead letters of a stream of files. A micro-batch that runs again replaces its own folders, so nothing is
    published twice; `published` below chunks_path is readable as one table."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")
        rows.where("error IS NOT NULL").select("file_md5", "path", "error", "attempts", "tried_ms").write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        rows.unpersist()

    return chunks_with_retries(files, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
