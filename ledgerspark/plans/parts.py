"""Queries for small parts that other queries don't show: names, scores, rows that fit, steps of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning, formats, ids
from ledgerspark.operators import logs, profile, statement, text
from ledgerspark.plans.registry import query, table

SAFE = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(translate(trim(lower({c})), ' -', '__'), '[^a-zA-Z0-9_.]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed')"
PATH = "regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[\\\\/:*?\"<>|]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT client_id, {SAFE.format(c='name')} AS part FROM clients")
def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clients").select("client_id", cleaning.id_part(F.col("name")).alias("part"))


@query(f"SELECT stamp_id, CASE WHEN coalesce(p, '') IN ('', '.', '..') THEN 'unnamed' ELSE p END AS part FROM (SELECT stamp_id, {PATH.format(c='raw')} AS p FROM stamps)")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stamps").select("stamp_id", cleaning.path_part(F.col("raw")).alias("part"))


@query("SELECT event_id, greatest(0.0, least(1.0, (value - 50 + 10) / 20)) AS score FROM events")
def scores_squashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.squashed(F.col("value") - 50).alias("score"))


@query("SELECT client_id, count(*) / (date_diff('day', max(ts), TIMESTAMP '2024-06-30') + 1) AS worth FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY client_id")
def evict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "clicks").where("client_id is not null and ts is not null").groupBy("client_id").agg(F.count("*").alias("n"), F.datediff(F.lit("2024-06-30"), F.max("ts")).alias("age"))
    return seen.select("client_id", logs.evict_score(F.col("n"), F.col("age")).alias("worth"))


@query("SELECT item_id, coalesce(nullif(name, ''), brand, '') AS content, coalesce(price, 0.0::DOUBLE) AS score FROM items")
def candidates_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of any source as content and score."""
    found = table(spark, sf_dir, "items").select("item_id", F.col("name").alias("content"), F.col("brand").alias("text"), F.col("price").alias("score"))
    return text.normalised(found).select("item_id", "content", "score")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE coalesce(length(text), 0) END AS vector FROM documents")
def embeddings_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents has vectors already; the others get theirs now, here their lengths."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    known = docs.where("chunk_id % 3 = 0").select("chunk_id", F.array(F.lit(-1)).alias("vector"))
    done = text.missing_embeddings(docs, known, lambda c: F.array(F.coalesce(F.length(c), F.lit(0))))
    return done.select(F.col("chunk_id").alias("doc_id"), F.get("vector", F.lit(0)).alias("vector"))


@query("SELECT stamp_id, raw FROM stamps WHERE raw IS NOT NULL AND lower(trim(raw, ' ')) NOT IN ('nan', 'none', '', 'na') AND try_cast(replace(trim(raw, ' '), ',', '') AS DOUBLE) IS NULL")
def labels_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label is a name, not a number."""
    return statement.named(table(spark, sf_dir, "stamps"), "raw").select("stamp_id", "raw")


ASKED = "special blue gear"


@query(f"SELECT p_partkey, hits FROM (SELECT p_partkey, {' + '.join(f'CAST(contains(lower(p_name), {chr(39)}{w}{chr(39)}) AS INT)' for w in ASKED.split())} AS hits FROM part) ORDER BY hits DESC, p_partkey LIMIT 20")
def rows_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.relevant_rows(table(spark, sf_dir, "part"), ASKED, "p_name", "p_partkey", 20).select("p_partkey", "hits")


@query(
    "SELECT 'l_discount' AS name, CASE WHEN min(l_discount) >= 0 AND max(l_discount) <= 1 AND max(l_discount) - min(l_discount) < 1 THEN 'ratio' ELSE 'metric' END AS kind FROM lineitem UNION ALL SELECT 'l_quantity', CASE WHEN min(l_quantity) >= 0 AND max(l_quantity) <= 1 THEN 'ratio' ELSE 'financial_metric' END FROM lineitem "
    "UNION ALL SELECT 'l_returnflag', CASE WHEN count(DISTINCT l_returnflag) < greatest(count(*) * 0.5, 20) THEN 'dimension' ELSE 'identifier' END FROM lineitem"
)
def columns_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What columns are, by names (quantities are a money matter) and ranges."""
    found = profile.classified(table(spark, sf_dir, "lineitem"), ["l_discount", "l_quantity", "l_returnflag"])
    return spark.createDataFrame(list(found.items()), "name string, kind string")


@query(f"SELECT client_id, {SAFE.format(c='source')} || '_' || {SAFE.format(c='name')} || '_' || CAST(client_id AS VARCHAR) AS key FROM clients WHERE source IS NOT NULL AND regexp_matches(source, '^[a-z]+$')")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clients").where(r"source is not null and source rlike '^[a-z]+$'")
    return rows.select("client_id", ids.chunk_key(F.col("source"), F.col("name"), F.col("client_id")).alias("key"))


@query("SELECT stamp_id, CASE WHEN regexp_full_match(raw, '[0-9]{10}') THEN CAST(raw AS BIGINT) * 1000000 WHEN regexp_full_match(raw, '[0-9]{13}') THEN CAST(raw AS BIGINT) * 1000 WHEN regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN epoch_us(try_cast(raw AS TIMESTAMP)) END AS micros FROM stamps")
def stamps_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times since 1970 and times in full; other spellings are for a reader who knows their source."""
    raw = F.col("raw")
    known = raw.rlike(r"^\d{10}$|^\d{13}$|^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    return table(spark, sf_dir, "stamps").select("stamp_id", F.unix_micros(cleaning.instant(F.when(known, raw))).alias("micros"))
