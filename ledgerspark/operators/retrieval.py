"""Lexical retrieval by an inverted index that is stored once and added to by batches.

An index is a folder. `postings`, by batch and bucket (a hash of the term): term, doc_id, f (how often) and n (the text's
words), sorted by term, and in bucket -1 a row without a term for each text; `terms`: how many texts of a batch hold each
term; `state`: one row for each state of the index, with its batches. A batch is written first and named in `stats` last, so readers see whole
batches or none, and what a failed batch leaves is never read. One writer at a time.

A question reads the buckets of its terms, and of their files the row groups that may hold them; the corpus isn't read
again. Where there are more tasks than buckets, those of a bucket's postings are dealt by document too.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.batches import parts
from ledgerspark.operators.text import B, IDF_FLOOR, K1, split
from ledgerspark.shipping import ship
from ledgerspark.storage import States, dealt, fingerprint, shared

#: How files are laid out; an index keeps its own number of buckets.
LAYOUT, BUCKETS = 2, 32
STATS = "batches array<string>, docs long, length long, mean_weight double, layout int, buckets int"


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, n, term, f for the words between white space of each text, in lower case, behind a row with a null term for
    the text. No text is shuffled unless all of them are small."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            places, lengths, terms, often = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = Counter(text.split())
                lengths += [found.total()] * (1 + len(found))
                places += [i] * (1 + len(found))
                terms += [None, *found.keys()]
                often += [0, *found.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.string()), pa.array(often, pa.int64())], ["doc_id", "n", "term", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))))).mapInArrow(run, f"doc_id {kind}, n long, term string, f long")


def state(spark: SparkSession, path: str) -> Row | None:
    """The index's latest state; None if there is no index yet."""
    now = States(spark, path, STATS).latest()
    if now is not None and now.layout != LAYOUT:
        raise ValueError(f"the index at {path} has layout {now.layout}, not {LAYOUT}")
    return now


def _read(spark: SparkSession, path: str, part: str, batches: list[str]) -> DataFrame:
    return spark.read.parquet(f"{path}/{part}").where(F.col("batch").isin(batches))


def texts(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    """doc_id, n of the texts of some batches."""
    return _read(spark, path, "postings", batches).where("bucket = -1").select("doc_id", "n")


def _weight(docs: int | Column, d: Column) -> Column:
    return F.log(docs - d + 0.5) - F.log(d + 0.5)


def add(path: str, docs: DataFrame) -> Row:
    """Adds docs (doc_id, text) to the index at path, which is made if it isn't there, and returns its new state. Texts whose
    ids it has already stay as they are. Ids that are null or come twice in docs are refused (ValueError)."""
    spark = docs.sparkSession
    now = state(spark, path)
    old = list(now.batches) if now else []
    new = docs.select("doc_id", "text")
    if old:
        new = new.join(texts(spark, path, old).select("doc_id"), "doc_id", "left_anti")
    batch = uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = now.buckets if now else BUCKETS
    rows = counted(new).withColumns({"batch": F.lit(batch), "bucket": F.coalesce(bucket(F.col("term"), buckets), F.lit(-1))})
    # a bucket's rows go to several tasks where there are more tasks than buckets
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // buckets)))
    rows.repartition(n, "bucket", spread).sortWithinPartitions("bucket", "term", "doc_id").write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/postings")
    written = _read(spark, path, "postings", [batch])
    if texts(spark, path, [batch]).groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        raise ValueError("ids of texts must be there, once each")
    held = written.where("term is not null").groupBy("bucket", "term").agg(F.count("*").alias("d"))
    held.repartition(min(n, buckets), "bucket").sortWithinPartitions("bucket", "term").withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/terms")
    batches = [*old, batch]
    total = texts(spark, path, batches).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    terms = _terms(spark, path, batches).agg(F.avg(_weight(F.lit(total.docs), F.col("d"))).alias("mean")).first()
    States(spark, path, STATS).add(batches, total.docs, total.length, terms["mean"] or 0.0, LAYOUT, buckets)
    return state(spark, path)


def _terms(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    return _read(spark, path, "terms", batches).groupBy("term").agg(F.sum("d").alias("d"))


def search(spark: SparkSession, path: str, question: str, k: int = 10) -> DataFrame:
    """doc_id, score of the k best by Okapi BM25, repeats in the question counted, ties by id. A term that more than half of
    all texts hold has a negative weight, for which a part of the mean weight of all terms stands in."""
    now, asked = state(spark, path), Counter(question.lower().split())
    if now is None:
        raise ValueError(f"no index at {path}")
    mine = lambda part: _read(spark, path, part, list(now.batches)).where(F.col("bucket").isin(sorted({bucket_of(t, now.buckets) for t in asked})) & F.col("term").isin(list(asked)))
    held = {r.term: r.d for r in mine("terms").groupBy("term").agg(F.sum("d").alias("d")).collect()}  # the question's terms
    weight = {}
    for term, d in held.items():
        own = math.log(now.docs - d + 0.5) - math.log(d + 0.5)
        weight[term] = asked[term] * (own if own >= 0 else IDF_FLOOR * now.mean_weight)
    if not weight:
        return mine("postings").select("doc_id", F.lit(0.0).alias("score")).limit(0)
    of = F.element_at(F.create_map(*(F.lit(x) for pair in weight.items() for x in pair)), F.col("term"))
    score = F.round(F.sum(of * _share(now)), 8)
    best = mine("postings").groupBy("doc_id").agg(score.alias("score")).where("score > 0")
    return best.orderBy(F.desc("score"), "doc_id").limit(k)


def _share(now: Row) -> Column:
    """What a term's count adds, before its weight."""
    mean = (now.length / now.docs if now.docs else 0.0) or 1.0
    return F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.lit(mean)))


def search_all(path: str, questions: DataFrame, k: int = 10) -> DataFrame:
    """question_id, rank, doc_id, score: search() for all questions (question_id, question) at once. Their terms join the
    postings; no question reads the corpus, and a question without known terms has no rows."""
    spark = questions.sparkSession
    now = state(spark, path)
    if now is None:
        raise ValueError(f"no index at {path}")
    asked = questions.select("question_id", F.explode(split(F.lower("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    asked = asked.withColumn("bucket", bucket(F.col("term"), now.buckets))
    batches = list(now.batches)
    own = _weight(F.lit(now.docs), F.col("d"))
    weight = F.when(own >= 0, own).otherwise(F.lit(IDF_FLOOR * now.mean_weight))
    known = asked.select("term", "bucket").distinct().join(_read(spark, path, "terms", batches), ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("d").alias("d"))
    weighed = asked.join(known.select("term", weight.alias("weight")), "term")
    found = _read(spark, path, "postings", batches).join(weighed, ["bucket", "term"])
    scored = found.groupBy("question_id", "doc_id").agg(F.round(F.sum(F.col("times") * F.col("weight") * _share(now)), 8).alias("score")).where("score > 0")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "doc_id", "score")


def index_of(docs: DataFrame) -> str:
    """The index of a frame of files, made where it isn't there yet: in the shared folder, under a name of these files."""
    spark = docs.sparkSession
    path = shared(spark, f"bm25-{LAYOUT}-{fingerprint(docs)}")
    if state(spark, path) is None:
        add(path, docs)
    return path
