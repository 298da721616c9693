"""Texts: chunks, fingerprints, lexical and vector retrieval."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.batches import parts
from ledgerspark.shipping import ship
from ledgerspark.storage import dealt

K1, B, IDF_FLOOR = 1.5, 0.75, 0.25  # fixed values of Okapi BM25
CROWD = 1000  # classes of more than the 1/CROWD part of all rows, of which there are fewer than CROWD, are broadcast
WORDS_KEPT = 1 << 17  # words whose hashes a task remembers, some 250 bytes each
VOTING = 1 << 14  # words of a text whose votes are added up at once
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: The same for RE2.
SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def split(text: Column) -> Column:
    """The text's words between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is one itself, an empty one none. The text is cut into characters once,
    held by an array of one."""
    chars = F.array(F.slice(F.split(text, ""), F.lit(1), F.length(text)))
    run = lambda c: lambda i: F.concat(*(c[i + k] for k in range(n)))
    many = F.transform(chars, lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - n), run(c))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(F.get(many, F.lit(0)))


def exact_duplicates(docs: DataFrame, digest=lambda c: F.sha2(c, 256), name: str = "text_sha256") -> DataFrame:
    """The digest, first_id, copies, of texts that occur more than once. Chunks and pages are told apart by F.md5."""
    return docs.groupBy(digest(F.col("text")).alias(name)).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, simhash: for each of 64 bits whether most words, with repeats, have it in the low half of their MD5; 0 for a
    text without words. The words of a text vote in one place; no word is shuffled."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}  # the words' rows in bits
        bits = np.zeros((0, 64), np.uint8)
        for batch in parts(batches):
            if len(known) > WORDS_KEPT:
                known = {}
            counts = [Counter(t.split()) for t in batch.column(1).to_pylist()]
            new = list({w for c in counts for w in c if w not in known})
            held, end = len(known), len(known) + len(new)
            known.update(zip(new, range(held, end), strict=True))
            if end > len(bits):
                bits = np.concatenate([bits[:held], np.zeros((max(end, 2 * len(bits)) - held, 64), np.uint8)])
            digests = b"".join(hashlib.md5(w.encode(), usedforsecurity=False).digest()[8:] for w in new)
            bits[held:end] = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
            out = np.zeros(len(batch), np.uint64)
            for i, c in enumerate(counts):
                if c:
                    votes = np.zeros(64)
                    for some in batched(c, VOTING):
                        votes += np.fromiter((c[w] for w in some), np.float64, len(some)) @ bits[[known[w] for w in some]].astype(np.float64)
                    out[i] = np.packbits(2 * votes > c.total()).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "simhash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))))).mapInArrow(run, f"doc_id {kind}, simhash long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: 64 bits in six blocks: where each begins, and its length.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def close_fingerprints(prints: DataFrame, bits: int = 3) -> DataFrame:
    """a, b, distance: pairs that differ in at most `bits` (up to 3) of 64. Such pairs agree in three of six blocks, keys of
    over 30 bits, so hardly any other pairs meet. Documents of one fingerprint are each paired with the smallest id among
    them, at distance 0; pairs of different fingerprints name those smallest ids, so every linked pair of documents
    follows from the rows."""
    prints = prints.persist()  # 16 bytes a document, read three times
    classes = prints.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    total = F.broadcast(classes.agg(F.sum("n").alias("total")))  # one row
    shared = classes.where("n > 1").join(total, F.lit(True)).select("simhash", F.col("doc_id").alias("a"), (F.col("n") * CROWD > F.col("total")).alias("crowd"))
    crowds = F.broadcast(shared.where("crowd").drop("crowd"))
    known = prints.select("simhash", F.col("doc_id").alias("b")).join(crowds, "simhash", "left")
    few = known.where("a is null").drop("a").join(shared.where("not crowd").drop("crowd"), "simhash")
    equal = known.where("a is not null").unionByName(few).where("b <> a").select("a", "b", F.lit(0).alias("distance"))
    part = lambda at, n: F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    keys = [F.struct(F.lit(k).alias("band"), F.struct(*(part(at, n) for at, n in three)).alias("part")) for k, three in enumerate(combinations(BLOCKS, 3))]
    banded = classes.select("doc_id", "simhash", F.explode(F.array(*keys)).alias("key")).select("doc_id", "simhash", "key.*")
    a, b = (banded.select(F.col("doc_id").alias(x), F.col("simhash").alias(f"s{x}"), "band", "part") for x in "ab")
    distance = hamming(F.col("sa"), F.col("sb"))
    near = a.join(b, ["band", "part"]).where((F.col("a") < F.col("b")) & (distance <= bits)).select("a", "b", distance.alias("distance")).distinct()
    return equal.unionByName(near)


def bm25(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """doc_id, score of the k best by Okapi BM25 over words between white space, repeats in the query counted. A term that
    more than half of all texts hold has a negative weight, for which a part of the mean weight of all terms stands in. Each
    text is split once and leaves the scan as its length and the query's counts."""
    asked = Counter(query.lower().split())
    terms = list(asked)
    tokens = split(F.lower(F.coalesce("text", F.lit(""))))
    # the array of one holds the split text, or it would be split again for each term
    counts = F.transform(F.array(tokens), lambda w: F.struct(F.size(w).alias("n"), *(F.size(F.filter(w, _equals(t))).alias(f"f{i}") for i, t in enumerate(terms))))
    counted = docs.select("doc_id", F.get(counts, F.lit(0)).alias("c")).select("doc_id", "c.*")
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    n, weights = stats.docs, {}
    for i, t in enumerate(terms):
        weights[t] = math.log(n - stats[f"d{i}"] + 0.5) - math.log(stats[f"d{i}"] + 0.5)
    if any(w < 0 for w in weights.values()):
        held = docs.select(F.explode(F.array_distinct(tokens)).alias("t")).groupBy("t").agg(F.count("*").alias("d"))
        mean = held.agg(F.avg(F.log(n - F.col("d") + 0.5) - F.log(F.col("d") + 0.5))).first()[0]
        weights = {t: w if w >= 0 else IDF_FLOOR * mean for t, w in weights.items()}
    score = sum((asked[t] * weights[t] * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("n") / F.lit(stats["mean"] or 1.0))) for i, t in enumerate(terms)), F.lit(0.0))
    found = counted.where(sum((F.col(f"f{i}") for i in range(len(terms))), F.lit(0)) > 0)
    return found.select("doc_id", F.round(score, 8).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def _equals(term: str):
    return lambda w: w == term


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_of(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))


def cosine(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """vec_id, score of the k best; a zero vector scores 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("vec_id", F.round(cosine_of(F.col("embedding"), q), 8).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


DIM, FIRST = 384, 100


def embedded(text: Column, dim: int = DIM) -> Column:
    """A vector without a model: each of the first 100 words adds 1 over its position at the place that its MD5 names;
    of length 1, or zero for a text without words."""
    w = F.slice(split(F.lower(F.coalesce(text, F.lit("")))), 1, FIRST)
    at = F.transform(w, lambda x, i: F.struct(F.pmod(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int").alias("j"), (1.0 / (i + 1)).alias("v")))
    # arrays of one hold the words' places and the vector, or both would be made again for each component
    raw = lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.aggregate(F.filter(a, lambda x: x["j"] == j), F.lit(0.0), lambda s, x: s + x["v"]))
    summed = F.transform(F.array(at), raw)
    long = F.transform(summed, lambda v: F.struct(v.alias("v"), F.sqrt(_dot(v, v)).alias("n")))
    return F.get(F.transform(long, lambda r: F.transform(r["v"], lambda x: F.coalesce(F.try_divide(x, r["n"]), F.lit(0.0)))), F.lit(0))


def missing_embeddings(chunks: DataFrame, known: DataFrame, embed=embedded) -> DataFrame:
    """chunk_id, vector for all chunks (chunk_id, text): those known as they are, the others embedded now."""
    have = known.select("chunk_id", "vector").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    new = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", embed(F.col("text")).alias("vector"))
    return have.unionByName(new)


def upserted(have: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The rows of both, of each key the one with the highest `version`; of equals that in `new`. Tables that are kept take
    upserts by bucket: `sources.versioned`."""
    both = have.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`").alias(c) for c in have.columns)), F.struct("version", "is_new")).alias("r"))
    return best.select(*(F.col("r")[c].alias(c) for c in have.columns))


#: How many go from one step of the funnel to the next, and by how much a search is widened.
LEXICAL, VECTOR, WIDER, MOST, LOW, AGAIN, MOST_AGAIN = 500, 50, 3, 50, 0.7, 2, 100


def reranked(found: DataFrame, query: str, k: int, score: Column | None = None) -> DataFrame:
    """The k best of found (doc_id, text, score) by another score, by default the share of the query's words that a text
    holds; the earlier score and ids break ties."""
    asked = sorted(set(query.lower().split()))
    held = split(F.lower(F.coalesce("text", F.lit(""))))
    lexical = F.size(F.array_intersect(F.array(*map(F.lit, asked)).cast("array<string>"), held)) / F.lit(max(1, len(asked)))
    return found.withColumn("rerank_score", score if score is not None else lexical).orderBy(F.desc("rerank_score"), F.desc("score"), "doc_id").limit(k)


def squashed(score: Column) -> Column:
    """A cross-encoder's score between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 10) / 20))


def funnel(docs: DataFrame, query: str, k: int = 10, filters: dict | None = None, lexical: DataFrame | None = None) -> DataFrame:
    """doc_id, vector_score, rerank_score: the 500 lexically best, those that meet all filters, the 50 best of them, by
    cosine, and at last by words. Vectors are made for the 50 only. lexical: doc_id, score of the first step, as an index
    finds them; without it the texts are searched."""
    near = (bm25(docs, query, LEXICAL) if lexical is None else lexical).withColumnRenamed("score", "bm25_score").join(docs, "doc_id")
    near = near.where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in (filters or {}).items()), F.lit(True)))
    some = near.orderBy(F.desc("bm25_score"), "doc_id").limit(VECTOR)
    scored = some.withColumn("score", F.round(cosine_of(embedded(F.col("text")), embedded(F.lit(query))), 8))
    return reranked(scored, query, k).select("doc_id", F.col("score").alias("vector_score"), F.round("rerank_score", 8).alias("rerank_score"))


def widened(search, k: int, threshold: float = 0.5, rerank: bool = True) -> DataFrame:
    """search(n) gives the n best as (…, score). First three times k; if fewer than k of what comes back reach the threshold,
    their mean is low and there were fewer than asked for, twice as many are asked for."""
    first = min(k * WIDER if rerank else k, MOST)
    found = search(first)
    row = found.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.count_if(F.col("score") >= threshold).alias("good")).first()
    if row.n and row.good < k and row["mean"] < LOW and row.n < first:
        found = search(min(first * AGAIN, MOST_AGAIN))
    return found.where(F.col("score") >= threshold).orderBy(F.desc("score")).limit(k)


def normalised(found: DataFrame) -> DataFrame:
    """Candidates of any source as content and score: `content`, or else `text`; no score is 0."""
    col = lambda n: F.col(n) if n in found.columns else F.lit(None)
    content = F.coalesce(F.when(col("content").cast("string") != "", col("content").cast("string")), col("text").cast("string"), F.lit(""))
    return found.withColumns({"content": content, "score": F.coalesce(col("score").cast("double"), F.lit(0.0))})


def chunks(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """doc_id, chunk, text: windows of characters that overlap."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    return docs.where("text is not null and text <> ''").select("doc_id", "text", F.posexplode(starts).alias("chunk", "at")).select("doc_id", "chunk", F.substring("text", F.col("at") + 1, F.lit(size)).alias("text"))


CHUNK, OVERLAP, LEAST = 500, 50, 100


def paragraphs(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """doc_id, chunk, text: paragraphs put together up to `size` characters, a new chunk beginning with the last `overlap`
    ones of the one before; chunks under `least` are left out."""
    parts = F.filter(F.transform(F.split("text", rf"\n{SPACE}*\n"), stripped), lambda p: p != "")

    def step(s, p):
        full = F.length(s["now"]) + F.length(p) > size
        kept = F.when(full & (F.length(s["now"]) >= least), F.concat(s["out"], F.array(stripped(s["now"])))).otherwise(s["out"])
        now = F.when(full, F.concat(F.right(s["now"], F.lit(overlap)), F.lit(" "), p)).otherwise(stripped(F.concat(s["now"], F.lit("\n\n"), p)))
        return F.struct(now.alias("now"), kept.alias("out"))

    def end(s):
        return F.when(F.length(s["now"]) >= least, F.concat(s["out"], F.array(stripped(s["now"])))).otherwise(s["out"])

    found = F.aggregate(parts, F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out")), step, end)
    return docs.where("text is not null").select("doc_id", F.posexplode(found).alias("chunk", "text"))


def table_chunks(docs: DataFrame, size: int = CHUNK, least: int = LEAST) -> DataFrame:
    """doc_id, chunk, text: lines of a table put together up to `size` characters, each chunk headed by the first line."""
    lines = F.split(stripped(F.col("text")), "\n")
    head = lines[0]

    def step(s, x):
        full = s["size"] + F.length(x) > size
        kept = F.when(full & (s["size"] >= least), F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"])
        now = F.concat(F.when(full, s["head"]).otherwise(s["now"]), F.lit("\n"), x)
        fits = F.when(full, F.length(s["head"])).otherwise(s["size"]) + F.length(x)
        return F.struct(s["head"].alias("head"), now.alias("now"), fits.alias("size"), (F.when(full, 1).otherwise(s["parts"]) + 1).alias("parts"), kept.alias("out"))

    def end(s):
        return F.when(s["parts"] > 1, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"])

    first = F.struct(head.alias("head"), head.alias("now"), F.length(head).alias("size"), F.lit(1).alias("parts"), F.array().cast("array<string>").alias("out"))
    found = F.aggregate(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), first, step, end)
    return docs.where("text is not null").select("doc_id", F.posexplode(found).alias("chunk", "text"))


def document_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, kind, chunk, text: tables by lines, other texts by paragraphs."""
    kind = docs.withColumn("kind", content_type(F.col("text")))
    tables, prose = table_chunks(kind.where("kind = 'table'")), paragraphs(kind.where("kind = 'prose'"))
    cut = lambda df, k: df.select("doc_id", F.lit(k).alias("kind"), "chunk", "text")
    return cut(tables, "table").unionByName(cut(prose, "prose"))


#: Letters of scripts that English texts don't hold (Unicode ranges).
OTHER_SCRIPTS = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2B81F), (0x3040, 0x30FF), (0xAC00, 0xD7AF), (0x0600, 0x06FF), (0x0750, 0x077F), (0x0400, 0x04FF), (0x0500, 0x052F), (0x0E00, 0x0E7F), (0x0590, 0x05FF), (0x0900, 0x097F)]
OTHER = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in OTHER_SCRIPTS) + "]"


def non_english(text: Column) -> Column:
    """Whether more than a tenth of the letters are of scripts that English texts don't hold."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    other = F.length(letters) - F.length(F.regexp_replace(letters, OTHER, ""))
    return F.coalesce(other > 0.1 * F.length(letters), F.lit(False))


def packed_to_budget(items: DataFrame, budget: int, at_once: int = 1000) -> DataFrame:
    """group, kept ids, used: in order of rank, each item that still fits; a later small one may fit after a large one.
    items: group, rank (without ties in a group), id, size. A round folds the first `at_once` items of each group that may
    still fit, so no task holds a group; a group with more of them goes on in the next round."""
    state = items.select("group").distinct().select("group", F.lit(0).cast("long").alias("used"), F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ids"))
    sized = items.select("group", F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    while True:
        fits = sized.join(state, "group").where("size <= {0} - used and (last is null or rank > last)".format(budget))
        some = fits.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("rank"))).where(F.col("n") <= at_once)
        begin = F.struct(F.any_value("used").alias("used"), F.any_value("ids").alias("ids"))
        held = some.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "size"))).alias("x"), begin.alias("s"))
        take = lambda s, x: F.when(s["used"] + x["size"] <= budget, F.struct((s["used"] + x["size"]).alias("used"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s)
        done = held.select("group", F.aggregate("x", F.col("s"), take).alias("s"), F.size("x").alias("n"), F.element_at("x", -1)["rank"].alias("at"))
        new = done.select("group", F.col("s.used").alias("new_used"), F.col("s.ids").alias("new_ids"), "at", "n")
        state = state.join(new, "group", "left").select("group", F.coalesce("new_used", "used").alias("used"), F.coalesce("at", "last").alias("last"), F.coalesce("new_ids", "ids").alias("ids"))
        if not done.where(F.col("n") == at_once).limit(1).count():
            return state.select("group", "ids", "used")


def context(found: DataFrame, tokens: int = 2000, joint: str = "\n\n---\n\n") -> DataFrame:
    """context, used: the best of what a search found (doc_id, text, score), as many as fit, best first, as one text for a
    model; four characters count as a token."""
    rows = found.select(F.lit(0).alias("group"), "doc_id", "text", F.col("score").cast("double").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "doc_id")))
    picked = packed_to_budget(rows.select("group", "rank", F.col("rank").alias("id"), F.length("text").alias("size")), 4 * tokens)
    kept = picked.select("group", "used", F.explode("ids").alias("rank")).join(rows, ["group", "rank"])
    return kept.groupBy("group", "used").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("t")).select(F.array_join(F.transform("t", lambda x: x["text"]), joint).alias("context"), "used")


def content_type(text: Column) -> Column:
    """`table` if the first ten lines show more than three signs of columns, else `prose`."""
    lines = F.slice(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), "\n"), 1, 10)
    columns = F.size(F.filter(lines, lambda x: x.rlike(r"[\t|]")))
    numbers = F.size(F.filter(lines, lambda x: x.rlike(r"[0-9]+\s+[0-9]+\s+[0-9]+")))
    return F.when(columns + numbers > 3, "table").otherwise("prose")


#: Words of a question that don't count.
STOP = ["what", "is", "the", "for", "in", "a", "an", "and", "or", "of", "to", "with", "how", "why"]


def relevant(docs: DataFrame, query: str, least: float = 0.2, k: int = 3) -> DataFrame:
    """doc_id, score: the k documents that hold the largest share of the question's words, without texts in other
    scripts. Words of under three characters count as not found; a question without words scores 0.5 everywhere."""
    asked = sorted(set(query.lower().split()) - set(STOP))
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((low.contains(w).cast("int") for w in asked if len(w) >= 3), F.lit(0))
    score = hits / len(asked) if asked else F.lit(0.5)
    return docs.where(~non_english(F.col("text"))).select("doc_id", F.round(score, 8).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "doc_id").limit(k)


SEEDS, MEMORY = 128, 100_000


class Sketcher:
    """Signatures of sets of shingles; lives in a Python worker and remembers shingles' values, at most 2 * MEMORY of them
    (a hundred MB for 128 seeds, of which pages without values take none)."""

    def __init__(self, perms: int):
        self.seeds = [i.to_bytes(4, "little") for i in range(perms)]
        self.place: dict[str, int] = {}
        self.values = np.empty((2 * MEMORY, perms), np.uint32)

    def __call__(self, shingles: list[str]) -> list[int]:
        least = None
        for i in range(0, len(shingles), MEMORY):
            some = shingles[i : i + MEMORY]
            if len(self.place) + len(some) > 2 * MEMORY:
                self.place = {}
            for s in some:
                if s not in self.place:
                    at = self.place[s] = len(self.place)
                    b = s.encode()
                    digests = b"".join(hashlib.sha256(seed + b).digest()[:4] for seed in self.seeds)
                    self.values[at] = np.frombuffer(digests, "<u4")
            now = self.values[[self.place[s] for s in some]].min(0)
            least = now if least is None else np.minimum(least, now)
        return [0] * len(self.seeds) if least is None else least.tolist()


def minhash(docs: DataFrame, id_col: str, perms: int = SEEDS, text: Column | None = None) -> DataFrame:
    """id, signature: for each seed the least 32-bit value, little-endian, of SHA-256 over seed and 3-character shingle;
    zeros for an empty text. A hash depends on the shingle only, of which there are few, so workers remember them, which
    no expression can; nothing is shuffled."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), shingles(F.coalesce(F.col("text") if text is None else text, F.lit(""))).alias("s"))

    def run(batches):
        sketch = Sketcher(perms)
        for batch in parts(batches):
            found = [sketch(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], [id_col, "signature"])

    return rows.mapInArrow(run, f"{id_col} long, signature array<long>")


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of places where two signatures agree; 0 for empty ones and for different lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(F.lit(0.0))


def near_before(chunks: DataFrame, least: float = 0.8, window: int = 500, perms: int = 128) -> DataFrame:
    """seq, dup_of, similarity: each chunk (seq, text) that resembles one of the `window` chunks before it, with the earliest
    of those. Chunks meet by blocks of `window` places, so each is compared with a bounded number of others."""
    signed = minhash(chunks, "seq", perms, F.lower(stripped(F.col("text")))).withColumn("block", F.floor(F.col("seq") / window))
    before = signed.select(F.col("seq").alias("other"), F.col("signature").alias("other_signature"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    pairs = signed.join(before, "block").where(F.col("seq").cast("long") - F.col("other") > 0).where(F.col("seq") - F.col("other") <= window)
    scored = pairs.select("seq", "other", signature_similarity(F.col("signature"), F.col("other_signature")).alias("similarity")).where(F.col("similarity") >= least)
    return scored.groupBy("seq").agg(F.min(F.struct("other", "similarity")).alias("m")).select("seq", F.col("m.other").alias("dup_of"), F.round("m.similarity", 6).alias("similarity"))


def sparse_pages(pages: DataFrame, threshold: int = 100, most: int = 20) -> DataFrame:
    """doc_id, page, chars, route: pages with little text, the `most` sparsest of a document, are for reading by sight."""
    sparse = F.col("chars") < threshold
    rank = F.row_number().over(Window.partitionBy("doc_id", sparse).orderBy("chars", "page"))
    return pages.withColumn("rank", rank).select("doc_id", "page", "chars", F.when(sparse & (F.col("rank") <= most), "vision").otherwise("text").alias("route"))
