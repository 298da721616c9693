"""What both vector searches share: clean vectors as packed doubles, and merging of partial best lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.shipping import ship


def clean(table: DataFrame, zero: bool, beside: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """vec_id, vec (packed doubles) and the long columns `beside`, and the dimension. Null vectors, vectors that hold null or non-finite components
    and, unless `zero`, zero vectors are left out, and so are rows without an id and vectors of another length than
    the most common one."""
    ship(table.sparkSession)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), *(F.col(c).cast("long").alias(c) for c in beside))
    rows = rows.where("vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    if not zero:
        rows = rows.where("exists(e, x -> x <> 0)")
    common = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 1

    def pack(batches):
        for batch in batches:
            e = batch.column(1)
            flat = e.flatten().to_numpy().astype("<f8").reshape(len(batch), d) if len(batch) else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary()), *batch.columns[2:]], ["vec_id", "vec", *beside])

    return rows.where(F.size("e") == d).mapInArrow(pack, ", ".join(["vec_id long, vec binary", *(f"`{c}` long" for c in beside)])), d


def unpack(blobs, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, d)


def longest(x: np.ndarray) -> np.ndarray:
    """Squared lengths; infinite where doubles can't hold them."""
    with np.errstate(over="ignore"):
        return (x * x).sum(1)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of all rows of a and of b, integers held in doubles whose squared lengths are `most` at most,
    itself under 2 ** 63. Products and their partial sums are no larger, so doubles are exact below 2 ** 53; beyond, longs
    are, as sums modulo 2 ** 64 of numbers that fit."""
    if most < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; of an id that comes twice only the better one."""
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def merged(parts: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score from rows of query_id, ids, scores (packed 64-bit values; kind: long or double)."""
    dtype, arrow = ("<i8", pa.int64()) if kind == "long" else ("<f8", pa.float64())

    def run(batches):
        now, ids, scores = None, [], []

        def done():
            i, s = np.concatenate(ids), np.concatenate(scores)
            at = best(s, i, k)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(np.arange(1, len(at) + 1, dtype=np.int32)), pa.array(i[at]), pa.array(s[at], arrow)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != now:
                    if now is not None:
                        yield done()
                    now, ids, scores = q, [], []
                ids.append(np.frombuffer(i, "<i8"))
                scores.append(np.frombuffer(s, dtype))
        if now is not None:
            yield done()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("query_id", "ids", "scores").repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(run, f"query_id long, rank int, vec_id long, score {kind}")
