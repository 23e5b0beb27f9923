"""A table with a key, in files of key ranges: an upsert or a delete rewrites only the files that hold a changed key.

`data/` holds files that are never changed, `files/<id>/` one Parquet table for each version: path, and least and greatest key, of
every file in it. The manifest names the current one. Readers of an older version aren't disturbed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import latest, publish, written

#: Rows of a file, about.
FILE_ROWS = 1_000_000


def _files(spark: SparkSession, folder: str) -> tuple[int, str, DataFrame | None]:
    """(version, key, the files of the current version)."""
    version, text = latest(spark, folder)
    if text is None:
        return 0, "", None
    m = json.loads(text)
    return version, m["key"], spark.read.parquet(f"{folder}/files/{m['files']}")


def _write(rows: DataFrame, folder: str, key: str, file_rows: int) -> DataFrame | None:
    """Write rows as new files by key range; their entries, or None without rows."""
    spark, place = rows.sparkSession, f"{folder}/data/{uuid.uuid4().hex}"
    n = rows.count()
    if not n:
        return None
    rows.repartitionByRange(-(-n // file_rows), key).sortWithinPartitions(key).write.parquet(place)
    return spark.read.parquet(place).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("rows"))


def _commit(spark: SparkSession, folder: str, key: str, version: int, entries: DataFrame) -> None:
    name = uuid.uuid4().hex
    entries.coalesce(1).write.parquet(f"{folder}/files/{name}")
    publish(spark, folder, version, json.dumps({"key": key, "files": name}))


def create(rows: DataFrame, folder: str, key: str, file_rows: int = FILE_ROWS) -> None:
    """Make the table; of rows that repeat a key one is kept, as in upsert. Rows without a key are left out."""
    spark = rows.sparkSession
    entries = _write(_one_each(rows, key), folder, key, file_rows)
    none = spark.createDataFrame([], f"path string, lo {rows.schema[key].dataType.simpleString()}, hi {rows.schema[key].dataType.simpleString()}, rows long")
    if entries is None:
        rows.limit(0).write.parquet(f"{folder}/data/empty")
    _commit(spark, folder, key, 1, none if entries is None else entries)


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: the greatest, in the order of the other columns, so that a second run keeps the same."""
    others = [F.desc(c) for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull())
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*others))).where("__n = 1").drop("__n") if others else kept.distinct()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the current version."""
    _, _, entries = _files(spark, folder)
    if entries is None:
        raise FileNotFoundError(f"no table at {folder}")
    paths = [r["path"] for r in entries.select("path").collect()]  # a row for each file
    return spark.read.parquet(*paths) if paths else spark.read.parquet(f"{folder}/data/empty")


def _touched(entries: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Of each file, whether a changed key lies in its range. A changed key meets the one file whose range begins last at or below it."""
    ranges = entries.select(F.col("lo").alias("k"), "path", "hi", F.lit(0).alias("o"))
    keys = changed.select(F.col(key).alias("k"), F.lit(None).cast("string").alias("path"), F.lit(None).cast(entries.schema["hi"].dataType).alias("hi"), F.lit(1).alias("o")).distinct()
    # files are dealt out by range with the keys: within a partition, the last file before a key is its own; a partition's first
    # keys may belong to the last file of the partitions before, so each partition gets that one too
    n = max(1, keys.sparkSession.sparkContext.defaultParallelism)
    bounds = entries.select("lo", "path", "hi")
    both = ranges.unionByName(keys).repartitionByRange(n, "k").sortWithinPartitions("k", "o").withColumn("part", F.spark_partition_id())
    both = written(both, "ranges")  # the bounds of a range partitioning are sampled: two readings could differ
    # one row for each partition: the least key in it decides which file is open at its beginning
    firsts = both.groupBy("part").agg(F.min("k").alias("least"))
    opened = firsts.join(bounds, F.col("lo") < F.col("least")).groupBy("part").agg(F.max_by(F.struct("path", "hi"), "lo").alias("before"))
    own = Window.partitionBy("part").orderBy("k", "o")
    last = F.last(F.when(F.col("o") == 0, F.struct("path", "hi")), ignorenulls=True).over(own)
    held = both.join(opened, "part", "left").withColumn("file", F.coalesce(last, "before"))
    return held.where((F.col("o") == 1) & (F.col("k") <= F.col("file.hi"))).select("file.path").distinct()


def upsert(changes: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> int:
    """Replace the rows whose key is among the changes, add the others; returns how many files were rewritten.

    Keys that lie in no file's range make new files and rewrite none. Of changes that repeat a key one counts, those without a
    key don't. A writer that another one overtook gets an error.
    """
    return _rewrite(changes, folder, True, file_rows)


def delete(gone: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> int:
    """Take out the rows whose key is among `gone`; returns how many files were rewritten."""
    return _rewrite(gone, folder, False, file_rows)


def _rewrite(changes: DataFrame, folder: str, keep: bool, file_rows: int) -> int:
    spark = changes.sparkSession
    version, key, entries = _files(spark, folder)
    if entries is None:
        raise FileNotFoundError(f"no table at {folder}")
    once = _one_each(changes, key) if keep else changes.select(key).where(F.col(key).isNotNull()).distinct()
    paths = [r["path"] for r in _touched(entries, once, key).collect()]  # names of files
    rows = spark.read.parquet(*paths).join(once.select(key), key, "left_anti") if paths else None
    if keep:
        rows = once if rows is None else rows.unionByName(once.select(*rows.columns))
    new = None if rows is None else _write(rows, folder, key, file_rows)
    left = entries.where(~F.col("path").isin(paths)) if paths else entries
    _commit(spark, folder, key, version + 1, left if new is None else left.unionByName(new))
    return len(paths)
