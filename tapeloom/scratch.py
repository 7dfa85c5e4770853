"""Tables that a job writes for itself: below the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder.

    Where the setting is missing, a local session gets a temporary folder; a cluster has no folder that all of its
    executors could read, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tapeloom/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back, which ends its lineage there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    """File system and path, from a path or a URL with escapes as Spark's file metadata has."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if "://" in path or path.startswith("file:") else jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    fs, p = _file(spark, path)
    fs.delete(p, True)


def swap(df: DataFrame, path: str) -> None:
    """Write a frame beside a dataset and give it its name: a failed write leaves the old one as it was."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}__next"
    df.write.mode("overwrite").parquet(new)
    fs, p = _file(spark, path)
    fs.delete(p, True)
    if not fs.rename(_file(spark, new)[1], p):
        raise OSError(f"the new table is left at {new}")


def arrange(spark: SparkSession, path: str, by: str) -> None:
    """Give the files of each partition `by`=n the time n seconds after a common start, the order in which a stream takes them."""
    fs, p = _file(spark, path)
    start = int(time.time()) - 1_000_000
    for folder_ in fs.listStatus(p):
        name = folder_.getPath().getName()
        if name.startswith(f"{by}="):
            for f in fs.listStatus(folder_.getPath()):
                fs.setTimes(f.getPath(), 1000 * (start + int(name.removeprefix(f"{by}="))), -1)


class Rounds:
    """Tables of a loop. The next round reads the last one, so a table goes when the second after it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def cut(self, df: DataFrame) -> DataFrame:
        path = folder(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            remove(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)
