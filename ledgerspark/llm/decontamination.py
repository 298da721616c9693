"""Benchmark decontamination by a prefix-filtered join, with DataFrame functions only.

An item's windows are its runs of WINDOW words; an item of fewer words, but not none, is one window. A document's word is
hit if it lies in a run of its words that equals a window. Windows and documents are sets of shingles (SHINGLE words, or
the whole window if it has fewer), and a window occurs where a document holds all its shingles in place. For containment in
full, the necessary prefix of a window in the order of rarity is its rarest shingle: documents' shingles are counted, for
shingles that windows have, and only the rarest shingle of each window joins. Shingles that occur nowhere drop their
windows at once. Of a joined place the window's start follows; starts before the document or ends behind it are left out
(length and positional bounds). What is left is verified word by word in the document.

All items' shingles make a bitmap (2 ** 18 words of 64 bits at most, hence broadcast) that leaves out other shingles
of documents before anything is shuffled; those that pass by chance drop out in the joins. Shingles and windows that are
more than a thousandth of what joins are dealt over several keys. Texts travel only for documents with joined places.

Documents: every row gives a row. Null and empty texts, and texts without words, have no words and no hits. A null doc_id
is a row like others. Rows that repeat have equal results, rows that share an id are told apart by their texts. Items:
those without words are in no document; a null item_id's windows hit words but aren't counted or listed; ids that repeat
count once. There are no ties: a window's prefix doesn't change what is found. Other columns, whatever their names, are unread.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored, with_bits

WINDOW, SHINGLE, HOT = 10, 3, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    """SQL for the words of a text; of null, none."""
    return f"filter(split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), w -> w <> '')"


def _shingles(hashes: str, m: int) -> str:
    """SQL for the hashes of all runs of m words, from those of the words."""
    parts = ", ".join(f"{hashes}[p + {i}]" for i in range(m))
    return f"transform(if(size({hashes}) < {m}, array(), sequence(0, size({hashes}) - {m})), p -> xxhash64({m}, {parts}))"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, words. doc_id and key name a row up to exact repetition."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.expr(_words("text")).alias("words"))


def _spread(left: DataFrame, right: DataFrame, key: str, place: str) -> DataFrame:
    """The inner join on a long column. Values that are more than a thousandth of left's rows, fewer than HOT, are dealt over
    several keys by `place`, an expression over left's columns."""
    counts = left.groupBy(key).agg(F.count("*").alias("times"))
    total = left.count()
    hot = counts.where(F.col("times") * HOT > total).select(key, F.expr(f"cast(1 + (times * {HOT}) div {max(1, total)} as int)").alias("shares"))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("salt", F.expr(f"coalesce(pmod({place}, shares), 0)")).drop("shares")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(shares, 1) - 1)"))).drop("shares")
    return salted.join(copies, [key, "salt"]).drop("salt")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win (its words), w (a hash of them), of the items' windows."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.expr(_words("text")).alias("words")).where("size(words) > 0")
    win = words.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(words) - {window - 1})), p -> slice(words, p, {window}))")).alias("win"))
    return win.select("item_id", "win", F.xxhash64("win").alias("w"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key, n_hit, wins: for documents in which windows occur, the words they cover and the windows."""
    wins = stored(windows_of(items, window).groupBy("win").agg(F.first("w").alias("w"))).withColumn("length", F.size("win"))
    # a window's shingles, with where they are in it
    short = [r.m for r in wins.select(F.least("length", F.lit(shingle)).alias("m")).distinct().collect()]  # `shingle` numbers at most
    hashes = wins.withColumn("hashes", F.expr("transform(win, x -> xxhash64(x))"))
    cases = " ".join(f"when {m} then {_shingles('hashes', m)}" for m in short)
    empty = "cast(array() as array<bigint>)"
    tokens = stored(hashes.select("w", "length", F.posexplode(F.expr(f"case least(length, {shingle}) {cases} else {empty} end" if short else empty)).alias("at", "h")))

    # places of windows' shingles in documents
    rows = _keyed(docs).select("doc_id", "key", F.expr("size(words)").alias("n"), F.expr("transform(words, x -> xxhash64(x))").alias("hashes"))
    shingles = f"flatten(array({', '.join(f'transform({_shingles("hashes", m)}, (h, p) -> struct(p, h))' for m in short)}))" if short else "cast(array() as array<struct<p:int,h:bigint>>)"
    found = rows.select("doc_id", "key", "n", F.explode(F.expr(shingles)).alias("s")).select("doc_id", "key", "n", F.col("s.p").alias("p"), F.col("s.h").alias("h"))
    places = stored(with_bits(found, "h", tokens.select("h").distinct()))

    # the rarest shingle of each window; one that occurs nowhere drops the window
    times = places.groupBy("h").agg(F.count("*").alias("times"))
    rarity = tokens.join(times, "h", "left")
    prefix = rarity.groupBy("w").agg(F.expr("min(struct(coalesce(times, 0L) as times, h, at, length))").alias("first")).select("w", "first.*").where("times > 0")
    prefix = stored(prefix.select("h", "w", "at", "length"))

    joined = _spread(places, prefix, "h", "xxhash64(doc_id, key, p)")
    starts = joined.select("doc_id", "key", "w", "n", F.expr("p - at").alias("s"), "length").where("s >= 0 and s + length <= n")
    starts = stored(starts.select("doc_id", "key", "w", "s"))
    named = _spread(starts, wins.select("w", "win"), "w", "xxhash64(doc_id, key, s)")
    by_doc = stored(named.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "w", "win")).alias("maybe")))

    # verified in the documents that have any
    whole = _keyed(with_text_of(docs, by_doc))
    both = whole.alias("d").join(by_doc.alias("c"), F.expr("d.doc_id <=> c.doc_id and d.key = c.key")).select("d.doc_id", "d.key", "words", "maybe")
    real = both.select("doc_id", "key", F.expr("array_sort(filter(maybe, c -> slice(words, c.s + 1, size(c.win)) = c.win))").alias("hits")).where("size(hits) > 0")
    cover = """aggregate(hits, named_struct('n', 0L, 'end', 0), (a, c) -> named_struct(
        'n', a.n + greatest(0, c.s + size(c.win) - greatest(a.end, c.s)), 'end', greatest(a.end, c.s + size(c.win))), a -> a.n)"""
    return real.select("doc_id", "key", F.expr(cover).alias("n_hit"), F.expr("array_distinct(transform(hits, c -> c.win))").alias("wins")).dropDuplicates(["doc_id", "key"])


def with_text_of(docs: DataFrame, some: DataFrame) -> DataFrame:
    """doc_id and text of docs whose key may be among some's."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    return with_bits(rows, "key", some.select("key").distinct()).select("doc_id", "text")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    hits = stored(occurrences(docs, items, window))
    wins = hits.select("doc_id", "key", F.explode("wins").alias("win")).withColumn("w", F.xxhash64("win"))
    owners = windows_of(items, window).where("item_id is not null").distinct().withColumnRenamed("win", "own")
    named = _spread(wins, owners, "w", "xxhash64(doc_id, key)").where("win = own")
    # first by document and item, so that what is gathered is a document's items
    named = named.select("doc_id", "key", "item_id").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_items"), F.expr("array_join(array_sort(collect_list(cast(item_id as string))), ',')").alias("ids"))
    named = named.alias("i")
    result = hits.select("doc_id", "key", "n_hit").alias("r").join(named, F.expr("r.doc_id <=> i.doc_id and r.key = i.key"), "left")
    result = stored(result.select(F.col("r.doc_id").alias("own"), F.col("r.key").alias("of"), "n_hit", "n_items", "ids"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    rows = rows.join(result, F.expr("doc_id <=> own and key = of"), "left")
    n_hit, n_items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("n_items", F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: DuckDB: all runs of words against all windows.
SQL = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM documents
), item AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, words[p : p + {WINDOW - 1}] AS win, least(len(words), {WINDOW}) AS n
    FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - {WINDOW - 1}) + 1)) AS p FROM item WHERE len(words) > 0)
), place AS (
    SELECT r, n, p, words[p : p + n - 1] AS win
    FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM win) WHERE len(words) >= n)
), hit AS (
    SELECT place.r, place.p, place.n, win.item_id FROM place JOIN win ON win.win = place.win
), word AS (
    SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS i FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r
), own AS (
    SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word ON word.r = doc.r LEFT JOIN own ON own.r = doc.r
"""


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """For tests: decontaminated() of (doc_id, text) and (item_id, text)."""

    def words(text: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - WINDOW + 1)) if w else ():
            windows.setdefault(tuple(w[p : p + WINDOW]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if of := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    own |= of - {None}
        out.append((i, len(w), len(hit), len(own), sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return out
