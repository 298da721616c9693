"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

New parts of texts (pieces.py) are cut by the pattern; pre-tokens that aren't tokens themselves become rows of
(word, position, token). The recursion joins neighbours with the merge table and contracts each word's leftmost pair
of the lowest rank until none is left. A word's further pairs of that rank contract in the same step where the order
can't matter: if no token that begins or ends with the pair's result ranks before it, no new pair can come first. An
ordered aggregation gives ids, and, over the ids joined with the tokens' bytes, decodes them, for each distinct
pre-token once; a text's ids and bytes are those of its pre-tokens in order. decoded() decodes whole lists of ids.

A null text is empty; null and repeated ids and repeated rows come back as they are. Texts may have any length. Other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import kept_by
from ledgerspark.llm.pieces import Memory, by_chars, parts
from ledgerspark.shipping import ship

NAME = "byte_bpe_multi_50k.tiktoken"
#: Unicode's White_Space, which the tokenizer library means by \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

MOST = 1_000_000  # parts remembered in a worker
STEP = 1 << 20  # bytes of pre-tokens in one query

CONTRACT = """
WITH RECURSIVE step(place, token, live) AS (
    SELECT place, token, true FROM symbols
    UNION ALL
    (WITH pairs AS (
        SELECT place, token, lead(token) OVER w AS after, lead(place) OVER w AS then_at, lag(place) OVER w AS before_at
        FROM step WHERE live WINDOW w AS (ORDER BY place)
    ), ranked AS (
        SELECT p.*, p.place >> 10 AS word, m.rank
        FROM pairs p LEFT JOIN merges m ON m.l = p.token AND m.r = p.after AND p.place >> 10 = p.then_at >> 10
    ), least AS (
        SELECT word, min(rank::BIGINT << 32 | (place & 1023)) AS best FROM ranked GROUP BY word
    )
    SELECT r.place, CASE WHEN r.place & 1023 = l.best & 1023 THEN (l.best >> 32)::INTEGER ELSE r.token END, l.best IS NOT NULL
    FROM ranked r JOIN least l ON l.word = r.word
    WHERE l.best IS NULL OR r.before_at IS DISTINCT FROM (r.word << 10 | (l.best & 1023)))
)
SELECT place >> 10 AS word, place & 1023 AS pos, token FROM step WHERE NOT live
"""

#: The same for long pre-tokens, whose pairs of one rank contract together where that is safe.
CONTRACT_LONG = """
WITH RECURSIVE step(word, pos, token, live) AS (
    SELECT word, pos, token, true FROM symbols
    UNION ALL
    (WITH pairs AS (
        SELECT s.word, s.pos, s.token, lead(s.token) OVER w AS after, row_number() OVER w AS n
        FROM step s WHERE s.live WINDOW w AS (PARTITION BY s.word ORDER BY s.pos)
    ), ranked AS (
        SELECT p.*, m.rank, m.alone FROM pairs p LEFT JOIN merges m ON m.l = p.token AND m.r = p.after
    ), least AS (
        SELECT word, min(rank) AS rank FROM ranked GROUP BY word
    ), hits AS (
        SELECT r.word, r.pos, r.n, r.rank, r.alone,
               row_number() OVER (PARTITION BY r.word ORDER BY r.n) AS k
        FROM ranked r JOIN least l ON r.word = l.word AND r.rank = l.rank
    ), picked AS (
        SELECT word, n, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY word, n - k ORDER BY n) AS in_run FROM hits
        ) WHERE (NOT alone AND in_run % 2 = 1) OR k = 1
    )
    SELECT r.word, r.pos, coalesce(h.rank, r.token), l.rank IS NOT NULL
    FROM ranked r JOIN least l ON l.word = r.word
    LEFT JOIN picked h ON h.word = r.word AND h.n = r.n
    LEFT JOIN picked g ON g.word = r.word AND g.n = r.n - 1
    WHERE g.word IS NULL)
)
SELECT word, pos, token FROM step WHERE NOT live
"""

#: Ids as decimals, and the bytes they decode to.
AGGREGATE = """
SELECT e.word, count(*), string_agg(e.token, ',' ORDER BY e.pos), from_hex(string_agg(t.hex, '' ORDER BY e.pos))
FROM encoded e JOIN tokens t ON t.id = e.token GROUP BY e.word
"""

DECODE = """
SELECT u.word, from_hex(string_agg(t.hex, '' ORDER BY u.i)) AS bytes
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM given_ids) u JOIN tokens t ON t.id = u.id
GROUP BY u.word
"""


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token; alone: whether its result may have to wait (see above)."""
    left, right, rank = [], [], []
    wait = set()
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            wait.update(x for x in (a, b) if x is not None and x > r)
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
    return pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32()), "alone": pa.array([r in wait for r in rank])})


class Coder:
    """Encodes and decodes; lives in a Python worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = merge_table(self.ranks)
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())}))
        self.db.execute("CREATE TABLE tokens AS SELECT id, bytes, hex(bytes) AS hex FROM given")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.memory = Memory(self.code_parts, MOST)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Each pre-token's number of ids, ids and decoded bytes. Those that are tokens need no merges; the bytes of all
        come from their ids, by the ordered aggregation."""
        out = [(0, b"", b"")] * len(words)
        single = [i for i, w in enumerate(words) if w in self.ranks]
        if single:
            self.db.register("encoded_given", pa.table({"word": pa.array(single, pa.int64()), "pos": pa.array([0] * len(single), pa.int64()), "token": pa.array([self.ranks[words[i]] for i in single], pa.int32())}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE encoded AS SELECT * FROM encoded_given")
            for w, n, ids, back in self.db.execute(AGGREGATE).fetchall():
                out[w] = (n, ids.encode(), back)
        rest = [i for i, w in enumerate(words) if w and w not in self.ranks]
        for query, chosen in ((CONTRACT, [i for i in rest if len(words[i]) <= 64]), (CONTRACT_LONG, [i for i in rest if len(words[i]) > 64])):
            some: list[int] = []
            size = 0
            for k, i in enumerate(chosen):
                some.append(i)
                size += len(words[i])
                if size < STEP and k + 1 < len(chosen):
                    continue
                lengths = np.array([len(words[x]) for x in some])
                pos = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                word = np.repeat(np.array(some, np.int64), lengths)
                token = self.byte[np.frombuffer(b"".join(words[x] for x in some), np.uint8)]
                columns = {"place": word << 10 | pos} if query is CONTRACT else {"word": word, "pos": pos}
                self.db.register("symbols", pa.table(columns | {"token": token}))
                self.db.execute("CREATE OR REPLACE TEMP TABLE encoded AS " + query)
                for w, n, ids, back in self.db.execute(AGGREGATE).fetchall():
                    out[w] = (n, ids.encode(), back)
                some, size = [], 0
        return out

    def decode_words(self, ids: list[list[int]]) -> list[bytes]:
        self.db.register("given_ids", pa.table({"word": pa.array(range(len(ids)), pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
        got = dict(self.db.execute(DECODE).fetchall())
        return [got.get(i, b"") for i in range(len(ids))]

    def code_parts(self, new: list[str]) -> list[tuple[int, bytes, bytes]]:
        split = [self.find(x) for x in new]
        if len(self.words) > self.memory.most:
            self.words.clear()
        words = list({w for s in split for w in s} - self.words.keys())
        if words:
            self.words.update(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        out = []
        for s in split:
            got = [self.words[w] for w in s]
            out.append(got[0] if len(got) == 1 else (sum(g[0] for g in got), b",".join(g[1] for g in got), b"".join(g[2] for g in got)))
        return out

    def __call__(self, texts: list[str]):
        """Number of ids, ids as decimals joined by commas, and the bytes they decode to, for each text."""
        for some in by_chars(texts):
            split = [parts(t) for t in some]
            self.memory.learn(split)
            for p in split:
                got = self.memory.look_up(p)
                counts, ids, back = zip(*(got if got[0][0] or len(got) == 1 else got[1:]), strict=True)
                yield sum(counts), b",".join(ids), b"".join(back)


def coder(path: str, pattern: str) -> Coder:
    kept = kept_by("byte_bpe")
    if (path, pattern) not in kept:
        kept[path, pattern] = Coder(path, pattern)
    return kept[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) for each row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        code = coder(path, pattern)
        for batch in batches:
            got = list(code(pc.fill_null(batch.column(1), "").to_pylist()))
            ids = [np.fromiter(map(int, g[1].split(b",")), np.int32, g[0]) if g[0] else np.zeros(0, np.int32) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes for rows of doc_id, ids."""
    ship(ids.sparkSession)

    def run(batches):
        code = coder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.decode_words([x or [] for x in batch.column(1).to_pylist()]), pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What op5 reports: encodes, decodes the ids, and digests both where the text is."""
    ship(docs.sparkSession)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        code = coder(path, pattern)
        for batch in batches:
            got = [(n, sha(ids), sha(back)) for n, ids, back in code(pc.fill_null(batch.column(1), "").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.string()) for i in (1, 2))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
