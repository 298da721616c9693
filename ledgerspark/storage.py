"""Folders that the driver and all executors share, and a name for the files that a frame reads."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, name: str) -> str:
    """A folder of that name under spark.checkpoint.dir. Only where that is unset and everything runs in one process on
    one machine (tests), it's a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ledgerspark-shared")
    return f"{base.rstrip('/')}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def fingerprint(files: DataFrame) -> str:
    """A name for what files hold: it changes with their paths, sizes or times. One number reaches the driver."""
    one = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = one.agg(F.count("*").alias("n"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}-{int(row.h or 0) % (1 << 64):016x}"


class States:
    """The states that something in a folder went through, a row each: what a state names is written first, its row last, so
    readers see the latest whole state, and a failed write leaves the one before. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, f"{path.rstrip('/')}/state", f"version long, {schema}"

    def latest(self) -> Row | None:
        return self.spark.read.schema(self.schema).parquet(self.path).orderBy(F.desc("version")).first() if exists(self.spark, self.path) else None

    def add(self, *values: object) -> None:
        now = self.latest()
        self.spark.createDataFrame([(now.version + 1 if now else 1, *values)], self.schema).coalesce(1).write.mode("append").parquet(self.path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


#: Bytes of input for each of the session's tasks up to which a frame is dealt out anew.
SMALL = 16 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df, and if it's small, by the optimizer's estimate, over all tasks: a small file is often one task's work, however long
    that takes. Larger ones stay as they are read, so nothing large is shuffled for it."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size <= n * SMALL else df
