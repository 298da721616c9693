"""Best-fit packing by a histogram of lengths.

Texts become token ids and pieces of at most `room` tokens; the pieces' bare places (no ids) are written once to the
shared folder. Counts by length, at most `room` rows however large the corpus, go to the driver, which plays best-fit
decreasing over counts: it fills groups of equal sequences at once and writes down, for ranges of ranks within a
length, the sequences and the offset they go to. The plan's size depends on `room`, not on the documents. Executors
expand it into slots, and pieces take their slots by a join on length and rank within the length, keys that spread
evenly. Ranks are dealt by (length, salt), with sums over the salts before, so a length that most pieces share doesn't
land in one task.

Nulls: a null text is empty and still ends in the separator; null and repeated ids keep their own slots, repeated rows
and ties in length too. A text of any length is encoded as a whole and cut into pieces. No other column is read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import ASCII_SPACE, kept_by, partitions, release, slices, stored, word_bounds
from ledgerspark.shipping import ship

NAME, ROOM, SEPARATOR, MOST = "word_bpe_49k.json", 2048, 0, 600_000
CHUNK = 1 << 16
#: Fixed value: how the tokenizer cuts lower-case text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Short words whose lower case is the same everywhere and that are composed already; none can hold a special token.
PLAIN = re.compile(r"(?!.*<\|)[\x21-\x7e\u00c0-\u012f\u0131-\u017e]{1,100}").fullmatch
#: What the tokenizer makes one pre-token of: lower-case letters (of two bytes up to U+00FF), a digit, or signs.
UNIT = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){1,100}|[0-9]|(?!.*<\|)[!-&(-/:-@\[-`{-~]{1,100}").fullmatch
LETTER, DIGIT, SIGN = 1, 2, 0
KIND = np.full(256, LETTER, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
OFTEN_ODD = np.ones(256, bool)  # bytes that keep a word from being cut here, unless a lead byte before them says otherwise
OFTEN_ODD[[*range(0x21, 0x7F), 0x20, *range(0x09, 0x0E), 0xC3]] = False
OFTEN_ODD[ord("'")] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What texts are encoded by, and the number of the first unit of each text (one more entry than texts). A word of
    ASCII and Latin-1 letters, digits and signs is cut into lower-case pre-tokens; any other word is one unit as it is."""
    starts, ends = word_bounds(data, offsets)
    n = len(data)
    two = np.zeros(n + 1, bool)  # bytes that follow a lead byte C3
    two[1:] = data == 0xC3
    two = two[:n]
    odd = OFTEN_ODD[data] & ~two
    odd |= two & ((data == 0x97) | (data == 0xB7))
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    strange = (np.add.reduceat(odd, starts, dtype=np.int64) > 0) | (ends - starts > 100) if len(starts) else np.zeros(0, bool)
    step = np.zeros(n + 1, np.int8)
    step[starts[strange]] += 1
    step[ends[strange]] -= 1
    whole = np.cumsum(step[:n], dtype=np.int8).view(bool)
    kind = KIND[data]
    low = np.where(two & (data >= 0x80) & (data <= 0x9E), data | 0x20, LOWER[data])
    low[whole] = data[whole]
    begin = np.zeros(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin &= ~whole
    begin[starts] = True
    word = ~ASCII_SPACE[data]
    begin &= word
    flat = low[word]
    at = np.append(np.flatnonzero(begin[word]), len(flat)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    return coded, np.searchsorted(np.flatnonzero(begin), offsets)


class Ids:
    """Token ids of texts; lives in a Python worker. The tokenizer drops white space and never joins across it, so
    units are encoded once, remembered, and gathered for all texts of a slice at once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.find = regex.compile(PRE_TOKEN).findall
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_units(self, new: list[bytes]) -> None:
        """Pre-tokens, many in one call: each ends in the only token of its own that closes a word."""
        groups = [new[i : i + 500] for i in range(0, len(new), 500)]
        for i in range(0, len(groups), 40):
            some = groups[i : i + 40]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
                if len(ends) != len(group):
                    self.known.update((u, self.encode(u.decode())) for u in group)
                    continue
                flat = ids.tobytes()
                self.known.update(zip(group, (flat[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def learn(self, new: list[bytes]) -> None:
        plain = [u for u in new if UNIT(u)]
        others = [u.decode() for u in new if not UNIT(u)]
        split = {w: [p.encode() for p in self.find(w.lower())] for w in others if PLAIN(w)}
        self.learn_units(list({*plain, *(p for s in split.values() for p in s)} - self.known.keys()))
        self.known.update((w.encode(), b"".join(map(self.known.__getitem__, s))) for w, s in split.items())
        self.known.update((w.encode(), self.encode(w)) for w in others if w not in split)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with the separator, and where each begins."""
        coded, first = units(data, offsets)
        kinds = coded.dictionary.to_pylist()
        if len(self.known) > MOST:
            self.known.clear()
        if new := [u for u in kinds if u not in self.known]:
            self.learn(new)
        blobs = list(map(self.known.__getitem__, kinds)) + [np.array([SEPARATOR], "<u4").tobytes()]
        for u in new:
            if len(u) > 100:  # long ones hardly come again
                del self.known[u]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        store, begin = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(size) - size
        codes = np.insert(coded.indices.to_numpy(), first[1:], len(kinds))
        ends = first[1:] + np.arange(1, len(first))  # units of the texts so far, separators counted
        size, begin = size[codes], begin[codes]
        top = np.cumsum(size)
        ids = store[np.arange(top[-1] if len(top) else 0) + np.repeat(begin - top + size, size)]
        return ids, np.append(0, top[ends - 1])


def ids_of(path: str) -> Ids:
    kept = kept_by("packing")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in kept:
        kept[path] = Ids(path)
    return kept[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """Each text's pieces of at most room tokens, the separator counted; with_ids adds the ids as uint32 bytes."""
    ship(docs.sparkSession)

    def run(batches):
        encode = ids_of(path)
        for batch in batches:
            for i, j, offsets, data in slices(batch, mine="packing"):
                ids, at = encode(data, offsets)
                count = -(-np.diff(at) // room)
                text = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                start = at[text] + piece * room
                end = np.minimum(start + room, at[text + 1])
                flat = memoryview(ids).cast("B")
                blobs = [flat[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                columns = [batch.column(0).slice(i, j - i).take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(piece * room), pa.array(end - start), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(b) for b in blobs], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def best_fit(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): ranks from first rank on go to sequences from first
    sequence on. Longest first, each into the fullest sequence that has room; equal sequences are handled as a group."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]  # by room left: (first sequence, how many)
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left, r = 0, counts[length], length
        while left:
            while r < room and not free[r]:
                r += 1
            if r < room:
                first, have = free[r].pop()
            else:
                each = room // length
                first, have = opened, -(-left // each)
                opened += have
            each = r // length
            full = min(have, left // each)
            for k in range(each):
                if full:
                    plan.append((length, rank + k * full, full, first, room - r + k * length))
            rank, left = rank + each * full, left - each * full
            if full:
                free[r - each * length].append((first, full))
            if full < have and left < each:  # what is left goes to one sequence more
                for k in range(left):
                    plan.append((length, rank + k, 1, first + full, room - r + k * length))
                if left:
                    free[r - left * length].append((first + full, 1))
                    full += 1
                if full < have and r < room:
                    free[r].append((first + full, have - full))
                left = 0
    return plan


def packed(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of the texts."""
    spark = docs.sparkSession
    salts = max(8, partitions(docs))
    rows = stored(pieces(docs, path, room).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = stored(rows.groupBy("length", "salt").agg(F.count("*").alias("n")))
    plan = best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room)

    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1
    ranked = rows.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    return ranked.join(slots(spark, plan), ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def slots(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """length, rank, sequence_id, offset: the plan's ranges of ranks as rows, in chunks that are expanded in parallel."""
    ranges = spark.createDataFrame(plan, "length long, first long, many long, sequence long, offset long")
    chunk = F.explode(F.expr(f"sequence(0L, (many - 1) div {CHUNK})")).alias("chunk")
    chunks = ranges.select("*", chunk).repartition("length", "first", "chunk")
    i = F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(many, (chunk + 1) * {CHUNK}) - 1)")).alias("i")
    return chunks.select("*", i).select("length", (F.col("first") + F.col("i")).alias("rank"), (F.col("sequence") + F.col("i")).alias("sequence_id"), "offset")


def sequences(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, as uint32 bytes. docs' ids name its rows."""
    places = packed(docs, path, room).select("doc_id", "piece", "sequence_id", "offset")
    return places.join(pieces(docs, path, room, True), ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
