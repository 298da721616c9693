"""Connected components by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerspark.llm.common import dropped, stored

EDGES = "v long, m long"


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for each node that has an edge to another. Each task first turns its
    edges into stars, which leaves fewer rounds to go."""
    first = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v > m")
    now, sign = _kept(first.mapInArrow(_stars, EDGES).distinct())
    while True:
        both = now.union(now.select(F.col("m").alias("v"), F.col("v").alias("m"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", "m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m")))).alias("e")).select("e.*").where("v > m").distinct()
        before = sign
        new, sign = _kept(small)
        dropped(now)
        now = new
        if sign == before:
            return now.select(F.col("v").alias("node"), F.col("m").alias("component"))


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and a sign by which sets of edges differ, from the same pass."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("sum")))
    return out, (seen.get["n"], seen.get["sum"])


def _stars(batches):
    """For each batch of edges, an edge from every node to the smallest one that the batch connects it with."""
    for batch in batches:
        v, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([v, m]), return_inverse=True)
        v, m = at[: len(v)], at[len(v) :]
        low = np.arange(len(nodes))
        while len(v):
            new = low.copy()
            np.minimum.at(new, v, low[m])
            np.minimum.at(new, m, low[v])
            np.minimum.at(new, low, new.copy())  # a root learns what its nodes have seen
            new = new[new]
            if (new == low).all():
                break
            low = new
        far = np.flatnonzero(low != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[low[far]])], ["v", "m"])
