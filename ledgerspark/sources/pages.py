"""Documents by page: text through a reader that the caller plugs in, chunks and fingerprints from there on in Spark."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import text
from ledgerspark.shipping import ship

Reader = Callable[[bytes], list[str]]


def plain_pages(content: bytes) -> list[str]:
    """Pages of plain text, cut at form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def read(spark: SparkSession, path: str, reader: Reader = plain_pages) -> DataFrame:
    """path, doc_hash, page (from 1), text of every page of every file; files are read and cut in the executors."""
    ship(spark)

    def cut(batches):
        for b in batches:
            rows = [(p, h, i, t) for p, h, c in zip(b["path"], b["doc_hash"], b["content"], strict=True) for i, t in enumerate(reader(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "doc_hash", "page", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("doc_hash"), "content")
    return files.mapInPandas(cut, "path string, doc_hash string, page int, text string")


def new_only(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages of documents whose hash isn't known yet; of documents that come twice the first path."""
    fresh = pages.join(known.select("doc_hash"), "doc_hash", "left_anti")
    first = fresh.groupBy("doc_hash").agg(F.min("path").alias("path"))
    return fresh.join(first, ["doc_hash", "path"], "left_semi")


def chunked(pages: DataFrame) -> DataFrame:
    """doc_hash, page, kind, chunk, text, text_md5 of every page."""
    keyed = pages.withColumn("doc_id", F.struct("doc_hash", "page"))
    return text.document_chunks(keyed).select("doc_id.doc_hash", "doc_id.page", "kind", "chunk", "text", F.md5("text").alias("text_md5"))


def written(chunks: DataFrame, path: str) -> None:
    """As JSON lines, by document."""
    chunks.write.mode("overwrite").partitionBy("doc_hash").json(path)
