"""Substring dedup by words: windows of consecutive words that also start in a document with a smaller id go.

Pass one: partition sketches of window hashes merge into a count-min sketch (sketch.py). Pass two: windows that the
sketch estimates repeated are grouped by 128 bits of hash, made of BLAKE2 hashes of whole words by a function that isn't
linear; a second equal pair of windows of other words is as good as impossible. A slice of texts first settles what it can alone:
of the occurrences of a window in the slice only those in the smallest document travel, so that a window that a
third of all documents hold sends one row for each slice, not for each document. The words that go are marked in the
input; the result doesn't depend on order or partitions.

Nulls: a null text has no words. A row whose id is null keeps all its words and removes nobody's. Rows with one id
don't remove each other's words; repeated rows each come back. Texts with fewer words than a window stay. Texts may have
any length. Other columns, whatever their names, are passed on unread by without_repeats. Ties: of equal windows those
in the document with the smallest id stay, however many there are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import sketch as cms
from ledgerspark.llm.common import column, fresh, input_bytes, mix, partitions, release, run_hashes, runs, slices, stored, with_bits, with_key, word_bounds, word_hashes

WORDS = 50
FEW_SPANS = 16 << 20  # bytes of spans, as stored, up to which they are broadcast


def windows(data: np.ndarray, offsets: np.ndarray, width: int, both: bool = False):
    """For each window in some texts: a 64-bit key and, on request, 64 more bits, its text's number and its first word."""
    starts, ends = word_bounds(data, offsets)
    w, other = word_hashes(data, starts, ends)
    firsts = np.searchsorted(starts, offsets)  # first word of each text
    counts = np.diff(firsts)
    keys = run_hashes(w, width)
    text = np.repeat(np.arange(len(counts)), counts)[: len(keys)]
    valid = np.arange(len(keys)) + width <= firsts[text + 1]
    if not both:
        return keys[valid]
    at = np.flatnonzero(valid)
    return keys[at], run_hashes(other, width)[at], text[at], at - firsts[text[at]]


def blob_rows(cuts: np.ndarray, columns: list[np.ndarray]):
    """(bucket, one bytes object for each column) for the buckets that have rows."""
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), [c[cuts[b] : cuts[b + 1]].tobytes() for c in columns]


BLOBS = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"


def blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "kind", "a", "b", "c", "d", "e"])


def marks_by_document(doc: np.ndarray, key: np.ndarray, at: np.ndarray, length: np.ndarray, buckets: int):
    """Blob rows of marked intervals, bucketed by the rows they belong to."""
    bucket = (mix(doc.astype(np.uint64) ^ mix(key.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, key, doc, bucket))
    doc, key, at, length, bucket = doc[order], key[order], at[order].astype(np.uint32), length[order].astype(np.uint32), bucket[order]
    new = runs([bucket, doc, key])
    size = np.diff(np.append(new, len(doc))).astype(np.uint32)
    of_bucket = bucket[new]
    cuts = np.searchsorted(of_bucket, np.arange(buckets + 1))
    tops = np.append(new, len(doc))
    for b in np.flatnonzero(np.diff(cuts)):
        i, j = cuts[b], cuts[b + 1]
        yield (int(b), 0, doc[new[i:j]].tobytes(), key[new[i:j]].tobytes(), size[i:j].tobytes(), at[tops[i] : tops[j]].tobytes(), length[tops[i] : tops[j]].tobytes())


def grouped(batches):
    """Rows that are sorted by bucket, a list for each bucket."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != now and rows:
                yield now, rows
                rows = []
            now = r["bucket"]
            rows.append(r)
    if rows:
        yield now, rows


def joined(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], dtype) for r in rows]) if rows else np.zeros(0, dtype)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The union of the intervals, given by ascending starts, as flat pairs (start, end)."""
    ends = starts + lengths
    top = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return np.stack([starts[first], top[last]], 1).ravel()


SPANS = "doc_id long, key long, spans binary"


def as_spans(batches):
    """From blob rows, sorted by bucket, to one row of spans for each document that has marks."""
    for _, rows in grouped(batches):
        size = joined(rows, "c", np.uint32)
        doc, key = (np.repeat(joined(rows, k, np.int64), size) for k in "ab")
        at, length = (joined(rows, k, np.uint32).astype(np.int64) for k in "de")
        order = np.lexsort((at, key, doc))
        doc, key, at, length = doc[order], key[order], at[order], length[order]
        new = runs([doc, key])
        out = [spans(at[i:j], length[i:j]).astype(np.int64).tobytes() for i, j in zip(new, np.append(new[1:], len(doc)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(key[new]), pa.array(out, pa.binary())], ["doc_id", "key", "spans"])


def repeated_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key, spans: word intervals that also occur in documents with smaller ids."""
    spark = docs.sparkSession
    texts = with_key(docs).where("doc_id is not null")
    buckets = 2 * partitions(docs)
    found = cms.build(texts.select("text"), lambda data, offsets: windows(data, offsets, words), input_bytes(docs) // 4)
    seen = spark.sparkContext.broadcast(found)

    def emit(batches):
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "key")
            for i, j, offsets, data in slices(batch):
                h, check, text, at = windows(data, offsets, words, True)
                maybe = seen.value.repeated(h)
                h, check, text, at = h[maybe], check[maybe], text[maybe], at[maybe]
                if not len(h):
                    continue
                doc, key = ids[i:j][text], keys[i:j][text]
                order = np.lexsort((doc, check, h))
                h, check, doc, key, at = h[order], check[order], doc[order], key[order], at[order]
                new = runs([h, check])
                least = np.repeat(doc[new], np.diff(np.append(new, len(h))))
                here = doc == least
                cuts = np.searchsorted((h[here] >> np.uint64(40)).astype(np.int64) * buckets >> 24, np.arange(buckets + 1))
                rows = [(b, 1, *blobs) for b, blobs in blob_rows(cuts, [h[here], check[here], doc[here], key[here], at[here].astype(np.uint32)])]
                rows += marks_by_document(doc[~here], key[~here], at[~here], np.full(int((~here).sum()), words), buckets)
                yield blob_batch(rows)
        release()

    def settle(batches):
        for bucket, rows in grouped(batches):
            own = [r for r in rows if r["kind"] == 1]
            out = [(bucket, 0, *(r[k] for k in "abcde")) for r in rows if r["kind"] == 0]
            if own:
                h, check, doc, key, at = (joined(own, k, t) for k, t in zip("abcde", (np.uint64, np.uint64, np.int64, np.int64, np.uint32), strict=True))
                order = np.lexsort((doc, check, h))
                h, check, doc = h[order], check[order], doc[order]
                new = runs([h, check])
                goes = doc != np.repeat(doc[new], np.diff(np.append(new, len(h))))
                out += marks_by_document(doc[goes], key[order][goes], at[order][goes], np.full(int(goes.sum()), words), buckets)
            if out:
                yield blob_batch(out)

    dealt = lambda df: df.repartition(buckets // 2, "bucket").sortWithinPartitions("bucket")
    settled = dealt(texts.mapInArrow(emit, BLOBS)).mapInArrow(settle, BLOBS)
    return dealt(settled).mapInArrow(as_spans, SPANS)


def with_spans(docs: DataFrame, found: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs' rows, all columns, with one more, whose name comes back: the spans, null where nothing goes. Spans that take up
    little room, which is measured, go to the texts; beyond that, texts of documents that may have spans, by a bitmap, go
    through a shuffle."""
    found = stored(found)
    number, maybe, own, key, spans = fresh(docs, "doc_number", "may_have", "span_id", "span_key", "spans_found")
    right = found.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("spans").alias(spans))
    same = (F.col(number) == F.col(own)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(key))
    if input_bytes(found) <= FEW_SPANS:
        joined = docs.withColumn(number, F.col("doc_id").cast("long")).join(F.broadcast(right), same, "left")
        return joined.select(*docs.columns, spans), spans
    flagged = with_bits(docs.withColumn(number, F.col("doc_id").cast("long")), number, found.select(F.col("doc_id").alias(own)), maybe)
    hit = flagged.where(F.col(maybe)).join(right, same, "left").select(*docs.columns, spans)
    rest = flagged.where(~F.col(maybe)).select(*docs.columns, F.lit(None).cast("binary").alias(spans))
    return hit.union(rest), spans


def kept_words(text: bytes, spans: bytes | None) -> tuple[int, int, list[bytes]]:
    """Number of words, of those removed, and the words that stay."""
    words = text.split()
    n = len(words)
    kept, last = [], 0
    for a, b in np.frombuffer(spans or b"", np.int64).reshape(-1, 2).tolist():
        kept += words[last:a]
        last = b
    kept += words[last:]
    return n, n - len(kept), kept


def substring_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of docs; kept_text is the kept words joined by one space."""

    def cut(batches):
        for batch in batches:
            got = [kept_words((t or "").encode(), s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([b" ".join(g[2]).decode() for g in got], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    rows, found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), repeated_words(docs, words))
    return rows.select("doc_id", "text", found).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def kept_text(text: str, spans: bytes) -> str:
    """The text without the words of its spans, each with the white space before it; what stays keeps its own."""
    words = list(WORD.finditer(text))
    out, last = [], 0
    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
        out.append(text[last : words[a - 1].end() if a else 0])
        last = words[b - 1].end()
    out.append(text[last:])
    return "".join(out)


WORD = re.compile(r"[^\x20\x09-\x0d]+")


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs' rows and columns with repeated passages cut out of text, each with the white space before its words; texts
    that lose nothing stay as they are. Documents of which no word is left go; those that had none before stay."""

    @F.pandas_udf("string")
    def shortened(texts, found):
        import pandas as pd

        return pd.Series([kept_text(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    rows, found = with_spans(docs, repeated_words(docs, words))
    (was,) = fresh(rows, "text_was")
    shortened = shortened.asNondeterministic()  # else a filter on the text has it run twice
    cut = rows.where(F.col(found).isNotNull()).withColumnRenamed("text", was)
    cut = cut.withColumn("text", shortened(was, found)).where(F.col("text").rlike(WORD.pattern))
    return cut.select(*docs.columns).union(rows.where(F.col(found).isNull()).select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """What op9 reports."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS) -> list[tuple[int, int, int, str]]:
    """For tests."""
    from ledgerspark.llm.reference import split_words

    first: dict[tuple, int] = {}
    split = [(i, split_words(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - words + 1):
            k = tuple(w[k : k + words])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - words + 1):
            if first[tuple(w[k : k + words])] < i:
                gone[k : k + words] = [True] * words
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out
