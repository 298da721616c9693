"""A Bloom filter as rows: executors set bits, OR merges them, files keep them, and a join asks.

A key has one of `words` words of 64 bits and PROBES bits in it, so a filter is a table of words, and asking is one equi-join.
Additions are written as the words they touch; reading merges what was written, so nothing is rebuilt and
no key reaches the driver. Keys can't be taken out: what is deleted elsewhere may still be answered with `perhaps`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.storage import States

PROBES = 6
#: Words up to which the filter is broadcast: 16 MB.
SMALL = 1 << 20


def place(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def mask(key: Column) -> Column:
    hashed = F.xxhash64(F.lit(1), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def words_for(keys: int, bits_each: int = 12) -> int:
    """So many words that a key has about that many bits: some 1 % of other keys are answered with `perhaps` then."""
    return max(16, -(-keys * bits_each // 64))


def bits_of(keys: DataFrame, key: str, words: int) -> DataFrame:
    """word, bits: the filter of a column's keys; null is no key."""
    rows = keys.select(F.col(key).cast("string").alias("k")).where("k is not null")
    return rows.select(place(F.col("k"), words).alias("word"), mask(F.col("k")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def asked(df: DataFrame, key: str, bits: DataFrame, words: int, to: str = "perhaps") -> DataFrame:
    """df with whether its key may be among those of the filter; null is not."""
    if words <= SMALL:
        bits = F.broadcast(bits)
    k = F.col(key).cast("string")
    held = bits.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    own = mask(k)
    return df.join(held, place(k, words) == F.col("__word"), "left").withColumn(to, F.coalesce(k.isNotNull() & (F.col("__bits").bitwiseAND(own) == own), F.lit(False))).drop("__word", "__bits")


class Membership:
    """A filter in a folder: `bits` by part, and a row of `state` for each addition, with the parts that count. A part is written
    before the row that names it, so readers see whole additions."""

    def __init__(self, spark: SparkSession, path: str, keys: int = 1_000_000):
        self.spark, self.path, self.words = spark, path.rstrip("/"), words_for(keys)
        self.states = States(spark, self.path, "words long, parts array<string>")
        if now := self.states.latest():
            self.words = now.words

    def bits(self) -> DataFrame:
        now = self.states.latest()
        if now is None:
            return self.spark.createDataFrame([], "word long, bits long")
        parts = self.spark.read.schema("word long, bits long, part string").parquet(f"{self.path}/bits").where(F.col("part").isin(list(now.parts)))
        return parts.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def add(self, keys: DataFrame, key: str) -> None:
        """Sets the bits of a column's keys."""
        self._written(bits_of(keys, key, self.words), [*(now.parts if (now := self.states.latest()) else [])])

    def compacted(self) -> None:
        """One part instead of many."""
        self._written(self.bits(), [])

    def _written(self, bits: DataFrame, others: list[str]) -> None:
        part = uuid.uuid4().hex
        n = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.words >> 17))
        bits.repartition(n, "word").withColumn("part", F.lit(part)).write.mode("append").partitionBy("part").parquet(f"{self.path}/bits")
        self.states.add(self.words, [*others, part])

    def asked(self, df: DataFrame, key: str, to: str = "perhaps") -> DataFrame:
        return asked(df, key, self.bits(), self.words, to)

    def among(self, df: DataFrame, key: str) -> DataFrame:
        """df's rows whose key may be there, and all that are."""
        return self.asked(df, key, "__perhaps").where("__perhaps").drop("__perhaps")

    def stats(self) -> DataFrame:
        """bits, bits_set, fill, rate: the share of other keys that are answered with `perhaps`, about."""
        total = self.words * 64
        return self.bits().agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("bits_set")).select(F.lit(total).alias("bits"), "bits_set", (F.col("bits_set") / total).alias("fill"), F.pow(F.col("bits_set") / total, F.lit(PROBES)).alias("rate"))


def semi_join(left: DataFrame, right: DataFrame, key: str, other: str, keys: int = 1_000_000) -> DataFrame:
    """left's rows whose key right has. A filter of right's keys keeps most other rows of left out of the shuffle."""
    words = words_for(keys)
    some = asked(left, key, bits_of(right, other, words), words, "__perhaps").where("__perhaps").drop("__perhaps")
    return some.join(right.select(F.col(other).alias("__other")).distinct(), F.col(key) == F.col("__other"), "left_semi")
