"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str, mark: str | None = None) -> str:
    """A new folder below spark.checkpoint.dir, or the one with this mark. A session in one JVM may go without that setting; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/tessera/{name}-{mark or uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path: for renames and listings, which Spark's readers don't offer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def latest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The number and text of the current version below `folder`; 0 and None where there is none."""
    fs, p = file_system(spark, f"{folder}/manifest")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return 0, None
    return int(names[-1][:-5]), spark.read.text(f"{folder}/manifest/{names[-1]}", wholetext=True).first()[0]


def publish(spark: SparkSession, folder: str, version: int, text: str) -> None:
    """Make `text` the current version: a finished file takes the version's name, which only one writer can do."""
    fs, draft = file_system(spark, f"{folder}/manifest/{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/{version:010d}.json")
    if fs.exists(path) or not fs.rename(draft, path):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} was published by another writer; read the manifest again and repeat")
