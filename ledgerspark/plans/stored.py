"""Queries over what is kept: membership filters, sketches by day, tables by version, JSON documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import aggregates, membership, sketches
from ledgerspark.plans.registry import query, table
from ledgerspark.sources import json_documents, versioned
from ledgerspark.storage import shared


def _new(spark: SparkSession, name: str) -> str:
    return shared(spark, f"{name}-{uuid.uuid4().hex}")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bloom_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of some customers: a filter of the customers' keys leaves most others out before the join."""
    some = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return membership.semi_join(table(spark, sf_dir, "orders"), some, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS keys, count(*) AS found, true AS few_others FROM (SELECT DISTINCT client_id FROM clicks WHERE client_id IS NOT NULL)")
def bloom_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter in files, added to month by month: all keys are found, few others."""
    clicks = table(spark, sf_dir, "clicks").where("client_id is not null")
    keys = clicks.select("client_id").distinct()
    kept = membership.Membership(spark, _new(spark, "members"), keys=100_000)
    for month in (F.month("ts") <= 2, (F.month("ts") > 2) | F.col("ts").isNull()):
        kept.add(clicks.where(month).select("client_id"), "client_id")
    told = kept.asked(keys.withColumn("there", F.lit(True)).unionByName(keys.select((-F.col("client_id") - 1).alias("client_id"), F.lit(False).alias("there"))), "client_id")
    others = F.count_if(~F.col("there") & F.col("perhaps")) <= 0.05 * F.count_if(~F.col("there"))
    return told.agg(F.count_if("there").alias("keys"), F.count_if(F.col("there") & F.col("perhaps")).alias("found"), others.alias("few_others"))


@query("SELECT kind, count(*) AS n, count(DISTINCT client_id) AS clients, true AS near, true AS again FROM clicks GROUP BY kind")
def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by kind of click: from sketches by day, merged; near the exact number, whichever way rows were divided."""
    clicks = table(spark, sf_dir, "clicks")
    days = sketches.by_day(clicks, "ts", ["kind"], ["client_id"])
    hours = sketches.by_day(clicks.withColumn("hour", F.hour("ts")), "arrived_at", ["kind", "hour"], ["client_id"])
    a = sketches.merged(days, ["kind"]).select("kind", "n", sketches.distinct_of("client_id").alias("estimate"))
    b = sketches.merged(hours, ["kind"]).select(F.col("kind").alias("other"), sketches.distinct_of("client_id").alias("again"))
    exact = clicks.groupBy(F.col("kind").alias("of")).agg(F.count_distinct("client_id").alias("clients"))
    both = a.join(b, F.col("kind").eqNullSafe(F.col("other"))).join(exact, F.col("kind").eqNullSafe(F.col("of")))
    near = lambda c: F.abs(F.col(c) - F.col("clients")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("clients"))
    return both.select("kind", "n", "clients", near("estimate").alias("near"), near("again").alias("again"))


@query("SELECT share, true AS near FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) t(share)")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of sales' totals from sketches by day, merged: the exact rank of each is near its share."""
    sales = table(spark, sf_dir, "sales").where("total is not null and not isnan(total)")
    whole = sketches.merged(sketches.by_day(sales, "sold_at", quantiles=["total"]))
    shares = [0.1, 0.5, 0.9, 0.99]
    told = whole.select(*(sketches.quantile_of("total", s).alias(f"q{i}") for i, s in enumerate(shares)))  # one row
    ranks = sales.join(F.broadcast(told), F.lit(True)).agg(F.count("*").alias("n"), *(F.count_if(F.col("total") < F.col(f"q{i}")).alias(f"below{i}") for i in range(4)), *(F.count_if(F.col("total") <= F.col(f"q{i}")).alias(f"upto{i}") for i in range(4)))
    error = 2 * sketches.RANK_ERROR
    near = [F.struct(F.lit(s).alias("share"), ((F.col(f"below{i}") <= (s + error) * F.col("n")) & (F.col(f"upto{i}") >= (s - error) * F.col("n"))).alias("near")) for i, s in enumerate(shares)]
    return ranks.select(F.explode(F.array(*near)).alias("r")).select("r.*")


@query("SELECT client_id, change_id, segment, city, balance FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC, balance DESC NULLS LAST, city DESC NULLS LAST, segment DESC NULLS LAST) AS n FROM client_changes WHERE client_id IS NOT NULL) WHERE n = 1")
def upsert_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of clients come in three batches; of each client the last one in sequence stays."""
    changes = table(spark, sf_dir, "client_changes").where("client_id is not null")
    rows = changes.select("client_id", "change_id", "segment", "city", "balance", F.struct("seq", "change_id", "balance", "city", "segment").alias("version"))
    kept = versioned.Table(spark, _new(spark, "clients"), "client_id", "version", 16)
    for i in range(3):
        kept.upsert(rows.where(F.pmod("change_id", F.lit(3)) == i))
    return kept.rows().drop("version")


@query("SELECT click_id, CAST(json_extract_string(i, '$.sku') AS BIGINT) AS sku, CAST(json_extract_string(i, '$.qty') AS BIGINT) AS qty FROM (SELECT click_id, unnest(CAST(json_extract(props, '$.items') AS JSON[])) AS i FROM clicks WHERE json_valid(props))")
def json_click_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items in clicks' properties, each click a document of its own shape."""
    texts = table(spark, sf_dir, "clicks").select(F.col("click_id").cast("string").alias("id"), F.col("props").alias("text"))
    every = json_documents.rows(json_documents.shapes(json_documents.parsed(texts))).where("table = 'items'")
    return json_documents.typed(every.select("id", "value")).select(F.col("id").cast("long").alias("click_id"), F.col("sku").cast("long").alias("sku"), F.col("qty").cast("long").alias("qty"))


@query("SELECT CASE WHEN NOT coalesce(json_valid(props), false) OR json_type(props) <> 'OBJECT' OR len(json_keys(props)) = 0 THEN 'unknown' WHEN len(list_filter(json_keys(props), lambda k: json_type(props, '$.\"' || k || '\"') <> 'ARRAY')) = 0 THEN 'lists' WHEN len(list_filter(json_keys(props), lambda k: json_type(props, '$.\"' || k || '\"') = 'ARRAY')) > 0 THEN 'nested_tables' ELSE 'single_record' END AS shape, count(*) AS n FROM clicks GROUP BY 1")
def json_click_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "clicks").select(F.col("click_id").cast("string").alias("id"), F.col("props").alias("text"))
    shaped = json_documents.shapes(json_documents.parsed(texts))
    return shaped.groupBy(F.when(F.col("shape") == "columnar", "lists").otherwise(F.col("shape")).alias("shape")).agg(F.count("*").alias("n"))


KURTOSIS = "SELECT l_returnflag AS g, round(kurtosis_pop(l_extendedprice), 6) AS value FROM lineitem GROUP BY l_returnflag"


@query(KURTOSIS)
def two_phase_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of one's own: states by task, merged by group."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g")
    return aggregates.aggregated(rows, "g", "l_extendedprice", aggregates.KNOWN["kurtosis_of"]).select("g", F.round("value", 6).alias("value"))


@query("SELECT kind AS g, round(exp(avg(ln(value))), 6) AS value FROM clicks WHERE value > 0 GROUP BY kind")
def two_phase_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from SQL, by functions of tables."""
    aggregates.register(spark, "geometric_mean")
    table(spark, sf_dir, "clicks").createOrReplaceTempView("two_phase_clicks")
    states = "SELECT * FROM geometric_mean_states(TABLE(SELECT kind, value FROM two_phase_clicks))"
    return spark.sql(f"SELECT g, round(value, 6) AS value FROM geometric_mean(TABLE({states}) PARTITION BY g) WHERE value IS NOT NULL")
