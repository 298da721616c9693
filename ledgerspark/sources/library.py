"""Documents to be asked: chunks, their vectors and an index, by tenant, added to as documents come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning
from ledgerspark.operators import retrieval, text
from ledgerspark.sources.versioned import Table


class Library:
    """A tenant's documents in root/client_id=…: `chunks` (a table by chunk with versions) and `index` (of their words). A
    tenant's files are its own; nobody else's are read for it."""

    def __init__(self, spark: SparkSession, root: str, client: str, embed: Callable[[Column], Column] = text.embedded):
        self.spark, self.client, self.embed = spark, cleaning.client_of(cleaning.tenant_of(client)), embed
        if self.client == "invalid":
            raise ValueError(f"invalid client: {client!r}")
        self.root = f"{root.rstrip('/')}/client_id={self.client}"
        self.table = Table(spark, f"{self.root}/chunks", "chunk_id", "version", 16)

    def ingest(self, docs: DataFrame) -> dict[str, int]:
        """Adds doc_id, text. Documents whose text is there already, under any id, and texts that come twice are passed over, as
        are texts without a chunk; gives the numbers of new documents and chunks. A document that changed has a new id."""
        hashed = docs.where("doc_id is not null and text is not null").withColumn("doc_hash", F.sha2("text", 256))
        first = hashed.groupBy("doc_hash").agg(F.min(F.col("doc_id").cast("string")).alias("doc_id"), F.first("text").alias("text"))
        have = self.table.rows()
        new = first if have is None else first.join(have.select("doc_hash").distinct(), "doc_hash", "left_anti")
        keyed = new.select(F.struct("doc_id", "doc_hash").alias("doc_id"), "text")
        made = text.document_chunks(keyed).select("doc_id.doc_id", "doc_id.doc_hash", "kind", "chunk", "text")
        chunks = made.withColumn("chunk_id", F.concat_ws("_", F.substring("doc_hash", 1, 24), "kind", F.col("chunk").cast("string")))
        rows = chunks.withColumns({"vector": self.embed(F.col("text")), "version": F.lit(1)}).persist()
        told = rows.agg(F.count_distinct("doc_hash").alias("documents"), F.count("*").alias("chunks")).first()
        if told.chunks:
            # the index passes over what it has, so a failure between the two is made good by ingesting again
            retrieval.add(f"{self.root}/index", rows.select(F.col("chunk_id").alias("doc_id"), "text"))
            self.table.upsert(rows)
        rows.unpersist()
        return {"documents": told.documents, "chunks": told.chunks}

    def status(self) -> dict[str, object]:
        """What there is: documents, chunks, words."""
        rows, now = self.table.rows(), retrieval.state(self.spark, f"{self.root}/index")
        if rows is None or now is None:
            return {"client": self.client, "documents": 0, "chunks": 0, "words": 0, "ready": False}
        told = rows.agg(F.count_distinct("doc_hash").alias("documents"), F.count("*").alias("chunks")).first()
        return {"client": self.client, "documents": told.documents, "chunks": told.chunks, "words": now.length, "ready": told.chunks > 0}

    def asked(self, question: str, k: int = 10, filters: dict | None = None) -> DataFrame:
        """chunk_id, doc_id, text, vector_score, rerank_score of the k best chunks: by words, then filters, then cosine, then
        the share of the question's words. No rows before anything is there."""
        rows = self.table.rows()
        if rows is None:
            return self.spark.createDataFrame([], "chunk_id string, doc_id string, text string, vector_score double, rerank_score double")
        lexical = retrieval.search(self.spark, f"{self.root}/index", question, text.LEXICAL)
        found = text.funnel(rows.drop("doc_id").withColumnRenamed("chunk_id", "doc_id"), question, k, filters, lexical)
        names = rows.select(F.col("chunk_id").alias("__chunk"), F.col("doc_id").alias("__doc"), "text")
        both = found.join(names, F.col("doc_id") == F.col("__chunk"))
        return both.select(F.col("doc_id").alias("chunk_id"), F.col("__doc").alias("doc_id"), "text", "vector_score", "rerank_score").orderBy(F.desc("rerank_score"), F.desc("vector_score"), "chunk_id")
