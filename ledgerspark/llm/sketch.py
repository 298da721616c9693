"""A count-min sketch of 64-bit keys, built by partition, merged by shard, kept as bits "counted twice or more".

Each task turns at most `limit` bytes of text at a time into keys, finds the keys' counters and sends them, sorted
and as differences of one byte, to the shards of the sketch; a shard adds them up. The result never underestimates:
a key that occurs twice has its bit set in every row. Its width is in proportion to the number of keys, so that it lets
the same share of single keys through at every size, up to 2 rows of 2 ** 28 bits; beyond the corpus size where that is
selective it lets more keys through and loses none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerspark.llm.common import mix, partitions, release, slices

ROWS, MOST, SHARD = 2, 1 << 28, 1 << 20
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def counters(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    high = (mix(keys) if row else keys) * SEEDS[row] >> np.uint64(32)
    return (high * np.uint64(width) >> np.uint64(32)).astype(np.uint32)


def as_bytes(values: np.ndarray) -> bytes:
    """Ascending values as differences; a byte 255 adds 255 and goes on."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    more = gaps // 255
    out = np.full(len(values) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def as_values(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b != 255]


def width_of(items: int) -> int:
    """Two counters for each key, in whole shards."""
    want = max(2 * items, 1 << 16)
    return min(MOST, want + -want % (SHARD if want > SHARD else 8))


class Sketch:
    def __init__(self, width: int, bits: list[np.ndarray]):
        self.width, self.bits = width, bits

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """True for each key that may occur twice or more."""
        found = np.ones(len(keys), bool)
        for row, bits in enumerate(self.bits):
            at = counters(keys, row, self.width)
            found &= (bits[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
        return found


def build(texts: DataFrame, keys_of, items: int) -> Sketch:
    """keys_of(bytes, offsets) gives the keys of some texts. items: about how many keys there are; sets the width."""
    width = width_of(items)
    shard = min(SHARD, width)
    shards = width // shard

    def count(batches):
        for batch in batches:
            for _, _, offsets, data in slices(batch):
                keys = keys_of(data, offsets)
                rows = []
                for row in range(ROWS):
                    at = np.sort(counters(keys, row, width))
                    keep = np.ones(len(at), bool)
                    keep[2:] = at[2:] != at[:-2]  # two are enough
                    at = at[keep]
                    cuts = np.searchsorted(at, np.arange(shards + 1, dtype=np.int64) * shard)
                    for s in np.flatnonzero(np.diff(cuts)):
                        rows.append((row << 16 | int(s), as_bytes(at[cuts[s] : cuts[s + 1]] - np.uint32(int(s) * shard))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "counts"])
        release()

    def add(batches):
        now, sums = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums > 1).tobytes()], pa.binary())], ["shard", "bits"])
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != now:
                    if now is not None:
                        yield done()
                    now, sums = s, np.zeros(shard, np.uint8)
                at = as_values(blob.as_py())
                twice = at[1:][at[1:] == at[:-1]]
                sums[at] = np.minimum(sums[at] + 1, 2)
                sums[twice] = 2
        if now is not None:
            yield done()

    sent = texts.mapInArrow(count, "shard int, counts binary")
    n = max(partitions(texts), 1)
    merged = sent.repartition(min(n, ROWS * shards), "shard").sortWithinPartitions("shard").mapInArrow(add, "shard int, bits binary")
    bits = [np.zeros(width // 8, np.uint8) for _ in range(ROWS)]
    size = shard // 8
    for r in merged.toLocalIterator():
        row, s = r.shard >> 16, r.shard & 0xFFFF
        bits[row][s * size : (s + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return Sketch(width, bits)
