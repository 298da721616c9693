"""Tables by key in bucketed files: an upsert rewrites the buckets that it touches, readers see whole states.

A row lies in the bucket that a hash of its key names, in files under `data/part=…/bucket=…`. A state says for each bucket which
part holds it now. Writing never changes files that a state names: new files come first, the state last. So a table can be
overwritten from itself, a write that fails leaves the table as it was, and readers of an older state aren't disturbed
until `vacuum` takes its files away.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.storage import States, deleted, folders


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the row with the largest values of `order`. Tasks keep one row for each key before they shuffle, so a key
    with many rows is no burden. Null keys are one key."""
    best = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*(F.col(f"`{c}`").alias(c) for c in rows.columns)), F.struct(*order)).alias("__row"))
    return best.select(*(F.col("__row")[c].alias(c) for c in rows.columns))


class Table:
    """key: the column that names a row; version: the column by which the newest of several rows of a key is told."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, buckets: int = 64):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), key, version, buckets
        self.states = States(spark, self.path, "buckets int, schema string, parts map<int,string>")
        if now := self.states.latest():
            self.buckets = now.buckets

    def rows(self, only: list[int] | None = None) -> DataFrame | None:
        """The table as it is now, or some of its buckets; None if nothing was written yet."""
        now = self.states.latest()
        if now is None:
            return None
        by_part: dict[str, list[int]] = {}
        for bucket, part in now.parts.items():
            if only is None or bucket in only:
                by_part.setdefault(part, []).append(bucket)
        files = self.spark.read.schema(f"{now.schema}, part string, bucket int").parquet(f"{self.path}/data") if by_part else self.spark.createDataFrame([], f"{now.schema}, part string, bucket int")
        # both are folders: only those named are read
        held = reduce(lambda a, b: a | b, ((F.col("part") == p) & F.col("bucket").isin(b) for p, b in by_part.items()), F.lit(False))
        return files.where(held).drop("part", "bucket")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, touched: list[int] | None, parts: dict[int, str]) -> None:
        part = uuid.uuid4().hex
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bucketed = self._bucketed(rows).withColumn("part", F.lit(part)).repartition(n, "bucket").sortWithinPartitions("bucket", self.key)
        bucketed.write.mode("append").partitionBy("part", "bucket").parquet(f"{self.path}/data")
        own = folders(self.spark, f"{self.path}/data/part={part}")
        written = {int(b.split("=")[1]) for b in own if b.startswith("bucket=")}
        kept = {} if touched is None else {b: p for b, p in parts.items() if b not in set(touched)}
        self.states.add(self.buckets, schema, kept | {b: part for b in written})

    def overwrite(self, rows: DataFrame) -> None:
        """The table becomes these rows, of each key the newest. They may come from the table itself."""
        self._write(latest(rows, self.key, [self.version]), None, {})

    def upsert(self, new: DataFrame) -> list[int]:
        """Of each key the newest row of the table and of `new` stays; `new` wins over rows as new as its own. Gives the buckets
        that were rewritten."""
        now = self.states.latest()
        if now is None:
            self.overwrite(new)
            return sorted(self.states.latest().parts)
        touched = sorted(r.bucket for r in self._bucketed(new).select("bucket").distinct().collect())  # self.buckets numbers at most
        old = self.rows(touched)
        both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*(F.col(f"`{c}`") for c in old.columns)).withColumn("__new", F.lit(1)))
        self._write(latest(both, self.key, [self.version, "__new"]).drop("__new"), touched, dict(now.parts))
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Takes the rows of some keys (a frame with the key column) out; gives the buckets that were rewritten."""
        now = self.states.latest()
        if now is None:
            return []
        touched = sorted(r.bucket for r in self._bucketed(keys.select(self.key)).select("bucket").distinct().collect())
        self._write(self.rows(touched).join(keys.select(self.key).distinct(), self.key, "left_anti"), touched, dict(now.parts))
        return touched

    def vacuum(self) -> int:
        """Deletes the parts that the latest state doesn't name; gives their number."""
        now = self.states.latest()
        old = [p for p in folders(self.spark, f"{self.path}/data") if p.startswith("part=") and (now is None or p[5:] not in now.parts.values())]
        for p in old:
            deleted(self.spark, f"{self.path}/data/{p}")
        return len(old)
