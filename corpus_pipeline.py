"""A corpus in five stages: language, lines, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() writes each stage to the shared folder and reads it again for the next one.

For every stage: an empty table gives an empty one. Null and empty texts go at the first stage. A row without an id is
judged by its language, keeps its lines and words, has no near duplicates and is packed. Rows that share an id count as
one document and don't remove each other's text; rows that repeat as a whole stay together until packing gives each its
own place. Ties go to smaller ids, then to earlier lines. Texts may have any length. Other columns are passed on up to
packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import language_id, line_dedup, minhash_dedup, packing, substring_dedup
from ledgerspark.llm.common import stored, table
from ledgerspark.llm.queries import tokenizer

#: Below this share of its words' likelihood the best language is no better than chance among several.
LEAST_SCORE = 0.3


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    return language_id.identified(docs, LEAST_SCORE)


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or nearly, go; so do documents that lose all their lines."""
    return line_dedup.without_repeated_lines(docs)


def by_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity the one with the smallest id stays."""
    return minhash_dedup.one_of_each(docs)


def by_passage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that a smaller document has too go; so do documents of which no word is left."""
    return substring_dedup.without_repeats(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in packed sequences."""
    return packing.packed(docs, tokenizer(packing.NAME))


STAGES = [
    ("language_id", by_language),
    ("line_dedup", by_line),
    ("minhash_near_dedup", by_minhash),
    ("substring_dedup", by_passage),
    ("best_fit_packing", into_sequences),
]

#: Language models, token ids and packing aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
