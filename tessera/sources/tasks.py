"""Reading tasks from a partitioned log with offsets, and the files that they name by path or http(s)."""

from __future__ import annotations

import http.client
import json
import os
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit
from urllib.request import url2pathname

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Seconds to connect, and between two pieces of an answer.
CONNECT, READ = 30, 180
PIECE = 1 << 20
LOG = re.compile(r"partition-(\d+)\.log")


class Forbidden(Exception):
    """The server refuses the file (403), as it does when a signed address has run out: another address is needed, not another try."""


def http_get(url: str, first: int | None = None, end: int | None = None, redirects: int = 5) -> bytes:
    """The body of a GET, or of the bytes from `first` to before `end`. Raises Forbidden for 403, ConnectionError for other failures."""
    at = urlsplit(url)
    kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
    c = kind(at.netloc, timeout=CONNECT)
    try:
        c.connect()
        c.sock.settimeout(READ)
        ranged = {"Range": f"bytes={first}-{end - 1}"} if first is not None else {}
        c.request("GET", at.path + (f"?{at.query}" if at.query else "") or "/", headers=ranged)
        answer = c.getresponse()
        if answer.status in (301, 302, 303, 307, 308) and redirects:
            return http_get(urljoin(url, answer.headers["Location"]), first, end, redirects - 1)
        if answer.status == 403:
            raise Forbidden(f"403 for {at.scheme}://{at.netloc}{at.path}")  # without the query, which may hold a signature
        if answer.status not in (200, 206):
            raise ConnectionError(f"{answer.status} for {at.scheme}://{at.netloc}{at.path}")
        body = answer.read()
        return body[first:end] if first is not None and answer.status == 200 else body
    except (OSError, http.client.HTTPException) as e:
        raise e if isinstance(e, ConnectionError) else ConnectionError(f"{type(e).__name__}: {e}") from e
    finally:
        c.close()


def is_remote(place: str) -> bool:
    return place.startswith(("http://", "https://"))


def local_path(place: str) -> str:
    return url2pathname(urlsplit(place).path) if place.startswith("file:") else place


def fetch(place: str) -> bytes:
    """The bytes of a file at a path that the machine can open, or at an http(s) address."""
    if is_remote(place):
        return http_get(place)
    with open(local_path(place), "rb") as f:
        return f.read()


def fetch_files(tasks: DataFrame, column: str = "url") -> DataFrame:
    """tasks with content, status (ok, forbidden, missing, failed) and error. One file is held at a time besides its batch's output, so
    the batch is kept at 16 tasks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema) + ", content binary, status string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 16):
                b, out = whole.iloc[i : i + 16], []
                for place in b[column]:
                    try:
                        out.append((fetch(place), "ok", None))
                    except Forbidden as e:
                        out.append((None, "forbidden", str(e)))
                    except FileNotFoundError as e:
                        out.append((None, "missing", str(e)))
                    except Exception as e:  # an address that can't be read costs its own row, not the task
                        out.append((None, "failed", f"{type(e).__name__}: {e}"))
                yield b.assign(**dict(zip(("content", "status", "error"), map(list, zip(*out, strict=True)), strict=True)))

    return tasks.mapInPandas(run, schema)


def _log_sizes(place: str) -> dict[int, int]:
    """Bytes of each partition up to its last whole line. An http(s) log lists `name size` lines at its address."""
    if is_remote(place):
        found = dict(x.split() for x in http_get(place).decode().splitlines() if x.strip())
        return {int(m[1]): int(n) for name, n in found.items() if (m := LOG.fullmatch(name))}
    sizes = {}
    for name in os.listdir(local_path(place)):
        if m := LOG.fullmatch(name):
            path = os.path.join(local_path(place), name)
            end, at = 0, os.path.getsize(path)
            with open(path, "rb") as f:
                while at and not end:  # from the end back to a line feed
                    begin = max(0, at - PIECE)
                    f.seek(begin)
                    cut = f.read(at - begin).rfind(b"\n")
                    end, at = (begin + cut + 1 if cut >= 0 else 0), begin
            sizes[int(m[1])] = end
    return sizes


def _log_bytes(place: str, partition: int, first: int, end: int) -> bytes:
    name = f"partition-{partition}.log"
    if is_remote(place):
        return http_get(f"{place.rstrip('/')}/{name}", first, end)
    with open(os.path.join(local_path(place), name), "rb") as f:
        f.seek(first)
        return f.read(end - first)


class _Stretch(InputPartition):
    """Bytes of one partition of the log."""

    def __init__(self, partition: int, first: int, end: int) -> None:
        self.partition, self.first, self.end = partition, first, end


class _Rows:
    """What batch and stream share: stretches to rows. Each row carries its offset, the byte at which its line begins."""

    def __init__(self, options: dict) -> None:
        self.place = options["path"]
        self.most = int(options.get("maxBytesPerPartition", 64 << 20))

    def read(self, partition: _Stretch) -> Iterator[tuple[int, int, str]]:
        at = partition.first
        for line in _log_bytes(self.place, partition.partition, at, partition.end).split(b"\n")[:-1]:
            yield partition.partition, at, line.decode("utf-8", "replace")
            at += len(line) + 1


class _LogReader(_Rows, DataSourceReader):
    def partitions(self) -> list[_Stretch]:
        return [_Stretch(p, 0, n) for p, n in sorted(_log_sizes(self.place).items()) if n]


class _LogStream(_Rows, DataSourceStreamReader):
    """Offsets are bytes by partition. A micro-batch takes at most maxBytesPerPartition of each, to the end of a line."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.told: dict[str, int] = {}
        self.done = options.get("committed")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for p, n in _log_sizes(self.place).items():
            before = self.told.get(str(p), 0)
            if n - before > self.most:
                piece = _log_bytes(self.place, p, before, before + self.most)
                n = before + piece.rfind(b"\n") + 1 if b"\n" in piece else n
            self.told[str(p)] = max(before, n)
        return dict(self.told)

    def partitions(self, start: dict, end: dict) -> list[_Stretch]:
        for p, n in start.items():  # after a restart, go on from there
            self.told[p] = max(self.told.get(p, 0), n)
        return [_Stretch(int(p), start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def commit(self, end: dict) -> None:
        """Where `committed` names a file, leave the offsets there for who trims the log."""
        if self.done:
            with open(f"{self.done}.new", "w") as f:
                json.dump(end, f)
            os.replace(f"{self.done}.new", self.done)


class TaskLog(DataSource):
    """Format task_log: files partition-<n>.log of lines at `path`, a folder that all machines share or an http(s) address."""

    @classmethod
    def name(cls) -> str:
        return "task_log"

    def schema(self) -> str:
        return "partition int, offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogStream(self.options)


#: The fields of a task.
TASK = "file_md5 string, url string, file_name string, user_id string, org_tag string, is_public boolean"


def read_tasks(spark: SparkSession, place: str, stream: bool = False, **options) -> DataFrame:
    """partition, offset and the fields of the tasks in a log; lines that aren't tasks have null fields and their text in `value`."""
    spark.dataSource.register(TaskLog)
    reader = (spark.readStream if stream else spark.read).format("task_log").option("path", place)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load().withColumn("t", F.from_json("value", TASK)).select("partition", "offset", "t.*", "value")
