"""Token counts by rank-synchronous array merging.

New parts of texts (pieces.py) go to the library's own pre-tokenizer; the pre-tokens' symbols lie in one ragged array.
In each round every sequence's lowest-ranked pair merges, all its occurrences at once, until no pair is in the merge
table; what survives is counted. Merging all occurrences at once gives what the library gives because a pair that
holds a merged symbol ranks after the merge that makes it, which is checked when the table is built.

Special strings inside texts count as one token, as is the library's default. A null text is empty; null and repeated
ids and repeated rows come back as they are. Texts may have any length. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import kept_by, runs
from ledgerspark.llm.pieces import Memory, by_chars, parts
from ledgerspark.shipping import ship

NAME, LIMIT = "byte_bpe_50k.json", 512
NEVER = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Pairs of symbols as sorted 64-bit keys, with their ranks and what they make."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        left, right = np.array(pairs, np.uint64).reshape(-1, 2).T
        keys = left << np.uint64(32) | right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)[order]
        born = dict(zip(made, range(len(made)), strict=True))
        assert len(born) == len(made) and all(max(born.get(a, -1), born.get(b, -1)) < r for r, (a, b) in enumerate(pairs))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NEVER), self.made[at]


def merged_lengths(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols each sequence keeps."""
    out = lengths.copy()
    who = np.flatnonzero(lengths > 1)
    seq = np.repeat(np.arange(len(lengths)), lengths)
    symbols = symbols[np.repeat(lengths > 1, lengths)]
    seq = seq[np.repeat(lengths > 1, lengths)]
    while len(who):
        rank, made = merges.find(symbols[:-1], symbols[1:])
        rank[seq[1:] != seq[:-1]] = NEVER
        rank, made = np.append(rank, NEVER), np.append(made, 0)
        begin = runs([seq])
        size = np.diff(np.append(begin, len(seq)))
        least = np.repeat(np.minimum.reduceat(rank, begin), size)
        hit = np.flatnonzero((rank == least) & (least != NEVER))
        if len(hit):  # of hits that overlap, as in a run of one symbol, every second
            new = np.ones(len(hit), bool)
            new[1:] = hit[1:] != hit[:-1] + 1
            place = np.arange(len(hit)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(hit))))
            hit = hit[place % 2 == 0]
            symbols[hit] = made[hit]
        keep = least != NEVER
        out[seq[begin[~keep[begin]]]] = size[~keep[begin]]
        keep[hit + 1] = False
        symbols, seq = symbols[keep], seq[keep]
        who = seq
    return out


class Counter:
    """Counts a text's tokens; lives in a Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary = model["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["model"]["merges"]]
        self.merges = Merges([(vocabulary[a], vocabulary[b]) for a, b in pairs], [vocabulary[a + b] for a, b in pairs])
        self.symbol = {c: vocabulary[c] for c in byte_chars()}
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.tokens: dict[str, int] = {}
        self.memory = Memory(self.count_parts)

    def count_parts(self, new: list[str]) -> list[int]:
        split = [[t for t, _ in self.pre.pre_tokenize_str(x)] for x in new]
        if len(self.tokens) > self.memory.most:
            self.tokens.clear()
        words = list({w for s in split for w in s} - self.tokens.keys())
        if words:
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            symbols = np.fromiter(map(self.symbol.__getitem__, "".join(words)), np.int64, int(lengths.sum()))
            self.tokens.update(zip(words, merged_lengths(symbols, lengths, self.merges).tolist(), strict=True))
        return [sum(map(self.tokens.__getitem__, s)) for s in split]

    def __call__(self, texts: list[str]) -> list[int]:
        out = []
        for some in by_chars(texts):
            segments, split = [], []
            for t in some:
                own = [t]
                for s in self.special:
                    own = [x for o in own for x in o.split(s)] if s in t else own
                segments.append(len(own))
                split += [parts(x) for x in own]
            self.memory.learn(split)
            counts = iter([sum(self.memory.look_up(p)) for p in split])
            out += [sum(next(counts) for _ in range(n)) + n - 1 for n in segments]
        return out


def counter(path: str) -> Counter:
    kept = kept_by("token_counts")
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        count = counter(path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n = np.array(count(text.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
