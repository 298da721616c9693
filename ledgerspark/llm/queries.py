"""The registered queries of this subpackage, thin around its operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import byte_bpe, decontamination, grouped_ranking, hilbert_search, language_id, line_dedup, minhash_dedup, mtree_search, negative_mining, packing, substring_dedup, suffix_dedup, token_counts
from ledgerspark.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer(packing.NAME))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest(table(spark, sf_dir, "documents"), tokenizer(byte_bpe.NAME), public_tokenizers.PATTERN)


def op6_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_search.top_k(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(token_counts.NAME))


def op11_grouped_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_ranking.ranked_lines(table(spark, sf_dir, "sale_lines"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_mining.mined(table(spark, sf_dir, "embeddings").withColumn("label", F.expr(negative_mining.LABEL)))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_line_dedup, op3_best_fit_packing, op4_suffix_array_dedup, op5_byte_bpe, op6_hilbert_search, op7_language_id, op8_mtree_search, op9_substring_dedup, op10_token_counts, op11_grouped_ranking, op12_benchmark_decontamination, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.SQL, "op8_mtree_search": mtree_search.SQL, "op11_grouped_ranking": grouped_ranking.SQL, "op12_benchmark_decontamination": decontamination.SQL, "op13_hard_negatives": negative_mining.SQL}
