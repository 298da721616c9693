"""Suffix-array dedup by bytes: every byte under a 50-byte string that also starts in a smaller document goes.

A sparse suffix array. Of the suffixes of a text those count that start at an anchor: the leftmost minimum of hashed
24-byte grams in some 50-byte window. Equal windows have their anchor at the same place, so each 50-byte match meets at
equal suffixes. A sketch (sketch.py) of the anchors' grams leaves out suffixes whose gram never repeats. The others travel
with the bytes around them that their windows cover, to buckets that sampled splitters cut from the range of the
suffixes' 16 leading bytes. A bucket sorts its strings by multikey quicksort, eight bytes to a key, and compares
neighbours byte for byte. Suffixes that agree in 16 bytes fall on the same side of every boundary, and a match
agrees in 24 at least, so nothing that matches lies across one.

A slice of texts first settles what it can alone: of suffixes with equal surroundings only those of its smallest
document travel; their surroundings are told apart by 128 bits of hash. So copies, however many, send one row a slice.

Nulls: a null text is empty. A row whose id is null loses nothing and removes nothing. Rows with one id don't remove
each other's bytes; repeated rows each come back. Texts under 50 bytes stay. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import sketch as cms
from ledgerspark.llm.common import BASE, BASE2, BYTES, column, input_bytes, inverse, mix, partitions, powers, release, runs, slices, with_key
from ledgerspark.llm.substring_dedup import SPANS, as_spans, grouped, joined, marks_by_document, with_spans

WIDTH, GRAM, LEAD = 50, 24, 16
BLOCK = 1 << 20
SAMPLE_BYTES = 64 << 20


def sums(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(base, len(data))[: len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray):
    """For blocks of the texts' windows: block start, prefix sums, gram hashes, and for each run of windows with one
    anchor the first and last window and the anchor, within the block."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for b in range(0, max(0, len(data) - WIDTH + 1), BLOCK):
        part = data[b : b + BLOCK + WIDTH - 1]
        n = len(part) - WIDTH + 1
        total = sums(part, BASE)
        gram = mix((total[GRAM:] - total[:-GRAM]) * powers(inverse(BASE), len(part))[: len(part) - GRAM + 1])
        least = gram >> np.uint64(21) << np.uint64(21) | np.arange(len(gram), dtype=np.uint64)
        have = 1
        while have * 2 <= WIDTH - GRAM + 1:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        rest = WIDTH - GRAM + 1 - have
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        at = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        valid = np.arange(b, b + n) + WIDTH <= ends[b : b + n]
        first = valid.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        # a text's windows don't reach its last 49 bytes, so between texts there is a window that isn't valid
        last = valid
        last[:-1] &= first[1:] | ~valid[1:]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        yield b, part, total, gram, first, last, at[first]


def anchor_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = [gram[at] for _, _, _, gram, _, _, at in anchors(data, offsets)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def rows_of(flat: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A matrix of width bytes from each start; flat must reach that far."""
    return np.lib.stride_tricks.sliding_window_view(flat, width)[starts]


def classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of 8-byte keys: the numbers of the rows that have an equal one, sorted, and the
    starts of the runs of equal ones. Rows that are alone after some keys take no part in the next."""
    rows, group = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    new = np.zeros(0, np.int64)
    for c in range(keys.shape[1]):
        key = keys[rows, c]
        order = np.lexsort((key, group))
        rows, key, group = rows[order], key[order], group[order]
        new = runs([group, key])
        size = np.diff(np.append(new, len(rows)))
        keep = np.repeat(size > 1, size)
        group = np.repeat(np.arange(len(new)), size)[keep]
        rows = rows[keep]
        new = runs([group])
    return rows, new


def least_of(rows: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row of the classes, the smallest doc of its class."""
    if not len(rows):
        return np.zeros(0, np.int64)
    return np.repeat(np.minimum.reduceat(doc[rows], new), np.diff(np.append(new, len(rows))))


ENTRY = np.dtype([("left", "u1"), ("size", "u1"), ("n", "<u4")])
MOST = 2 * WIDTH - GRAM  # bytes around an anchor at most


def padded(width: int) -> int:
    return -(-width // 8) * 8


def settle_bucket(flat: np.ndarray, entry: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray):
    """Marks (doc, key, at, length) of a bucket's entries; at: for each entry n starts, one after the other."""
    size = entry["size"].astype(np.int64)
    starts = np.cumsum(size) - size
    flat = np.concatenate([flat, np.zeros(padded(MOST), np.uint8)])
    wide = rows_of(flat, starts, padded(MOST))
    wide[np.arange(wide.shape[1])[None, :] >= size[:, None]] = 0
    keys = np.concatenate([wide.view(">u8").astype(np.uint64), (entry["left"].astype(np.uint64) << np.uint64(8) | entry["size"])[:, None]], 1)
    rows, new = classes(keys)
    least = doc.copy()
    least[rows] = least_of(rows, new, doc)
    stands = np.arange(len(doc))  # for each entry the entry that stands for all that equal it
    if len(rows):
        stands[rows] = np.repeat(rows[new], np.diff(np.append(new, len(rows))))
    n = entry["n"].astype(np.int64)
    first = np.cumsum(n) - n
    whole = doc > least
    many = np.repeat(whole, n)
    marks = [(np.repeat(doc, n)[many], np.repeat(key, n)[many], at[many], np.repeat(size, n)[many])]

    one = np.unique(stands)
    grams = rows_of(flat, starts[one] + entry["left"][one], GRAM).view(">u8").astype(np.uint64)
    one = one[classes(grams)[0]]  # strings whose gram has other surroundings too
    if len(one):
        count = size[one] - WIDTH + 1
        owner = np.repeat(one, count)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        text = np.zeros((len(owner), padded(WIDTH)), np.uint8)
        text[:, :WIDTH] = rows_of(flat, starts[owner] + shift, WIDTH)
        rows, new = classes(text.view(">u8").astype(np.uint64))
        gone = np.zeros(len(owner), bool)
        gone[rows] = least[owner[rows]] > least_of(rows, new, least[owner])
        owner, shift = owner[gone], shift[gone]
        if len(owner):
            order = np.lexsort((shift, owner))
            owner, shift = owner[order], shift[order]
            begin = np.ones(len(owner), bool)
            begin[1:] = (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1] + 1)
            b = np.flatnonzero(begin)
            length = np.diff(np.append(b, len(owner))) + WIDTH - 1
            owner, shift = owner[b], shift[b]
            mine = np.flatnonzero(~whole)  # entries that still have to learn it, by the entry that stands for them
            mine = mine[np.argsort(stands[mine], kind="stable")]
            lo, hi = np.searchsorted(stands[mine], owner), np.searchsorted(stands[mine], owner, "right")
            k = hi - lo
            who = mine[np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            shift, length = np.repeat(shift, k), np.repeat(length, k)
            m = n[who]
            each = np.repeat(first[who], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            marks.append((np.repeat(doc[who], m), np.repeat(key[who], m), at[each] + np.repeat(shift, m), np.repeat(length, m)))
    return [np.concatenate([x[i] for x in marks]) for i in range(4)]


ROWS = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "kind", "a", "b", "c", "d", "e"])


def splitters(docs: DataFrame, texts: DataFrame, buckets: int) -> np.ndarray:
    """Leading bytes that cut a sample of the anchors into equal parts. The sample is of about SAMPLE_BYTES of the input."""

    def lead(batches):
        for batch in batches:
            for _, _, offsets, data in slices(batch, BLOCK):
                for _, part, _, gram, _, _, at in anchors(data, offsets):
                    at = np.unique(at)
                    at = at[gram[at] % np.uint64(32) == 0]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([rows_of(part, at, LEAD).tobytes()], pa.binary())], ["lead"])

    share = min(1.0, SAMPLE_BYTES / max(1, input_bytes(docs)))
    got = [r.lead for r in texts.sample(share, 1).mapInArrow(lead, "lead binary").collect()]
    found = np.unique(np.frombuffer(b"".join(got), f"S{LEAD}"))
    if len(found) < 2:
        return found[:0]
    return np.unique(found[np.linspace(0, len(found), buckets + 1).astype(int)[1:-1].clip(0, len(found) - 1)])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans: byte intervals under 50-byte strings that also start in documents with smaller ids."""
    spark = docs.sparkSession
    texts = with_key(docs).where("doc_id is not null")
    buckets = 4 * partitions(docs)
    # marks are a hundredth of the strings; every bucket of strings sends a row to each bucket of marks
    marked = partitions(docs, 32 << 20)
    cuts = splitters(docs, texts, buckets)
    found = cms.build(texts.select("text"), anchor_keys, input_bytes(docs) // 6)
    seen = spark.sparkContext.broadcast((found, cuts))

    def emit(batches):
        known, cut = seen.value
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "key")
            for i, j, offsets, data in slices(batch, 4 * BLOCK):
                got = []
                for b, part, total, gram, first, last, at in anchors(data, offsets):
                    maybe = known.repeated(gram[at])
                    first, last, at = first[maybe], last[maybe], at[maybe]
                    other = sums(part, BASE2)
                    end = last + WIDTH
                    h, g = ((t[end] - t[first]) * powers(inverse(base), len(part))[first] for t, base in ((total, BASE), (other, BASE2)))
                    got.append((first + b, end + b, at + b, mix(h + (at - first).astype(np.uint64)), mix(g + (end - first).astype(np.uint64))))
                if not got:
                    continue
                first, end, at, h, g = (np.concatenate(x) for x in zip(*got, strict=True))
                if not len(first):
                    continue
                text = np.searchsorted(offsets, first, "right") - 1
                doc, key = ids[i:j][text], keys[i:j][text]
                order = np.lexsort((first, key, doc, g, h))
                first, end, at, h, g, text, doc, key = (x[order] for x in (first, end, at, h, g, text, doc, key))
                new = runs([h, g])
                here = doc == np.repeat(doc[new], np.diff(np.append(new, len(h))))
                begin = first - offsets[text]
                out = [(*r[:2], *r[2:]) for r in marks_by_document(doc[~here], key[~here], begin[~here], (end - first)[~here], marked)]
                first, end, at, h, g, doc, key, begin = (x[here] for x in (first, end, at, h, g, doc, key, begin))
                new = runs([h, g, doc, key])
                times = np.diff(np.append(new, len(h)))
                one = new
                entry = np.zeros(len(one), ENTRY)
                entry["left"], entry["size"], entry["n"] = at[one] - first[one], end[one] - first[one], times
                flat = np.concatenate([data, np.zeros(LEAD, np.uint8)])
                lead = np.ascontiguousarray(rows_of(flat, at[one], LEAD)).view(f"S{LEAD}").ravel()
                bucket = np.searchsorted(cut, lead, "right")
                order = np.argsort(bucket, kind="stable")
                bucket, one, entry, times = bucket[order], one[order], entry[order], times[order]
                edges = np.searchsorted(bucket, np.arange(len(cut) + 2))
                for x in np.flatnonzero(np.diff(edges)):
                    a, z = edges[x], edges[x + 1]
                    size = entry["size"][a:z].astype(np.int64)
                    pick = np.repeat(first[one[a:z]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    n = times[a:z]
                    each = np.repeat(one[a:z] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    squeezed = pa.compress(data[pick].tobytes(), codec="zstd", asbytes=True)
                    out.append((int(x), int(size.sum()), squeezed, entry[a:z].tobytes(), doc[one[a:z]].tobytes(), key[one[a:z]].tobytes(), begin[each].astype(np.uint32).tobytes()))
                yield batch_of(out)
        release()

    def settle(batches):
        for _, rows in grouped(batches):
            own = [r for r in rows if r["kind"]]
            out = [tuple(r[k] for k in ("bucket", "kind", *"abcde")) for r in rows if not r["kind"]]
            if own:
                flat = np.concatenate([np.frombuffer(pa.decompress(r["a"], r["kind"], codec="zstd", asbytes=True), np.uint8) for r in own])
                out += marks_by_document(*settle_bucket(flat, joined(own, "b", ENTRY), joined(own, "c", np.int64), joined(own, "d", np.int64), joined(own, "e", np.uint32).astype(np.int64)), marked)
            if out:
                yield batch_of(out)

    dealt = lambda df, n: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    settled = dealt(texts.mapInArrow(emit, ROWS), buckets // 2).mapInArrow(settle, ROWS)
    return dealt(settled, marked).mapInArrow(as_spans, SPANS)


def kept_bytes(text: bytes, spans: bytes | None) -> tuple[int, bytes]:
    """How many spans go, and what stays."""
    pairs = np.frombuffer(spans or b"", np.int64).reshape(-1, 2).tolist()
    kept, last = [], 0
    for a, b in pairs:
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    return len(pairs), b"".join(kept)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of docs."""

    def cut(batches):
        for batch in batches:
            n, removed, count, kept = [], [], [], []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = (t or "").encode()
                c, k = kept_bytes(t, s)
                n.append(len(t))
                removed.append(len(t) - len(k))
                count.append(c)
                kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows, found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), repeated_bytes(docs))
    return rows.select("doc_id", "text", found).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """What op4 reports."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple]:
    """For tests."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, t in texts:
        for k in range(len(t) - width + 1):
            s = t[k : k + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < i:
                gone[k : k + width] = True
        count = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone[:-1].tolist(), strict=True) if not g)
        out.append((i, len(t), len(t) - len(kept), count, hashlib.sha256(kept).hexdigest()))
    return out
