"""What the operators share: input columns, partition counts, shared storage, byte-level views of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
import re
import tempfile
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.shipping import ship

#: What operators keep in a Python worker between tasks, by operator.
KEPT: dict[str, dict] = {}


def release(but: str | None = None) -> None:
    """Frees what operators keep in this worker, and gives it back to the system."""
    for other in KEPT.keys() - {but}:
        KEPT[other].clear()
        del KEPT[other]
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept_by(name: str) -> dict:
    """The memory of one operator in this worker; that of the others is freed, workers serve many stages. The memories
    hold millions of small objects without cycles, which the cycle collector would walk through again and again."""
    if KEPT.keys() - {name}:
        release(name)
    if name not in KEPT:
        gc.disable()
    return KEPT.setdefault(name, {})


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, for files their size; 64 MB where it has none, as for rows from the driver. It sets
    numbers of partitions and the sketch's width, never a result."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 50 else 64 << 20


def partitions(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """So many that each holds about bytes_each of the input, and at least the session's shuffle partitions."""
    most = 1 << 17
    want = math.ceil(input_bytes(df) / bytes_each)
    return min(most, max(want, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir. Only where that is unset and everything runs in
    one process on one machine (tests), it's a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ledgerspark-checkpoints")
    return f"{base.rstrip('/')}/ledgerspark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, text (null: empty). doc_id and key together name a row up to exact repetition."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


BASE, BASE2 = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than ASCII white space, never across texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~ASCII_SPACE[data]
    first = np.zeros(len(data), bool)
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:]
    end = word
    last = np.zeros(len(data), bool)
    last[:-1] = first[1:]
    last[-1] = True
    tail = end.copy()
    tail[:-1] &= ~word[1:] | last[:-1]
    return np.flatnonzero(start), np.flatnonzero(tail) + 1


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The words, told apart byte by byte: codes and the distinct ones."""
    flat = data[~ASCII_SPACE[data]]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2 for each word, as two columns of 64."""
    coded = words_of(data, starts, ends)
    kinds = b"".join(blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist())
    both = np.frombuffer(kinds, "<u8").reshape(-1, 2)
    codes = coded.indices.to_numpy()
    return both[codes, 0], both[codes, 1]


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, in order; not linear, so that no pattern of words cancels out."""
    return mix(a * np.uint64(BASE) + mix(b ^ np.uint64(BASE2)))


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width values, by doubling: a run is hashed from two shorter ones that cover it."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        values = joint(values[:-step], values[step:])
        have += step
    return values


def slices(batch: pa.RecordBatch, limit: int = 8 << 20, mine: str = "texts"):
    """(first row, end row, offsets from 0, bytes) of a batch's text, about limit bytes each; a longer text comes alone."""
    kept_by(mine)
    column = batch.column(batch.schema.get_field_index("text"))
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def runs(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows of columns that are sorted together."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has: those given, with underscores before them as far as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def tables(batches, keys: int):
    """Rows that are sorted by their first columns: (keys, table) for each run of equal ones."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = runs(columns)
        for a, b in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


BIT_WORDS = 1 << 18


def with_bits(df: DataFrame, key: str, keys: DataFrame, flag: str | None = None) -> DataFrame:
    """df's rows whose long column `key` may be among keys' only column, and all that are: a broadcast bitmap, at most
    BIT_WORDS rows of 64 bits, that keeps the others out of a shuffle. With `flag`, all rows, told apart by that column."""
    word = lambda c: f"shiftrightunsigned(xxhash64(`{c}`), 6) & {BIT_WORDS - 1}"
    bit = lambda c: f"cast(xxhash64(`{c}`) & 63 as int)"
    w, b = fresh(df, "word", "bits")
    (name,) = keys.columns
    bits = F.broadcast(keys.groupBy(F.expr(word(name)).alias(w)).agg(F.expr(f"bit_or(shiftleft(1L, {bit(name)}))").alias(b)))
    joined = df.join(bits, F.expr(word(key)) == F.col(w), "left" if flag else "inner")
    hit = F.expr(f"bit_get({b}, {bit(key)}) = 1")
    if flag:
        return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(w, b)
    return joined.where(hit).drop(w, b)
