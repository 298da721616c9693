"""Queries that join on order: as-of, interval and overlap joins, over the test tables and the shop's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.operators.joins import asof_join, interval_join, overlap_join
from ledgerspark.plans.registry import query, table

ASOF = "SELECT event_id, p_partkey AS part FROM events ASOF LEFT JOIN part ON CAST(floor(value) AS BIGINT) >= p_partkey"


@query(ASOF)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the largest part key at or below its value, however far; null if there is none."""
    events = table(spark, sf_dir, "events").select("event_id", F.expr("cast(floor(value) as bigint)").alias("k"))
    return asof_join(events, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")), ("k", "part")).select("event_id", "part")


@query(ASOF)
def join_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; the name is older."""
    return join_asof(spark, sf_dir)


@query("""
WITH c AS (SELECT client_id, valid_at, max((seq, change_id, segment, city)) AS m FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY 1, 2)
SELECT click_id, k.client_id, m[2] AS change_id, m[3] AS segment, m[4] AS city FROM clicks k ASOF LEFT JOIN c ON k.client_id = c.client_id AND k.ts >= c.valid_at
""")
def asof_click_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with what its client was last changed to before; of changes at one time, the last in sequence."""
    clicks, changes = table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), table(spark, sf_dir, "client_changes")
    return asof_join(clicks, changes, ("ts", "valid_at"), ["client_id"], ["change_id", "segment", "city"], order=["seq", "change_id"]).drop("ts")


@query("""
WITH c AS (SELECT client_id, ts, max(click_id) AS click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
SELECT sale_id, s.client_id, sold_at, CASE WHEN ts <= sold_at + INTERVAL 1 HOUR THEN click_id END AS click_id FROM sales s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at < c.ts
""")
def asof_next_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale with the client's first click after it, within an hour."""
    sales, clicks = table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at"), table(spark, sf_dir, "clicks")
    return asof_join(sales, clicks, ("sold_at", "ts"), ["client_id"], ["click_id"], "forward", F.expr("interval 1 hour"), strict=True)


@query("""
WITH c AS (SELECT client_id, ts, max(click_id) AS click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT row_number() OVER () AS r, sale_id, client_id, sold_at FROM sales),
b AS (SELECT r, c.ts AS b_ts, c.click_id AS b_id FROM s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at >= c.ts),
f AS (SELECT r, c.ts AS f_ts, c.click_id AS f_id FROM s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at <= c.ts)
SELECT sale_id, client_id, CASE WHEN f_ts IS NOT NULL AND (b_ts IS NULL OR f_ts - sold_at < sold_at - b_ts) THEN f_id ELSE b_id END AS click_id FROM s JOIN b USING (r) JOIN f USING (r)
""")
def asof_nearest_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale with the client's click that is nearest in time, the earlier one of two."""
    sales, clicks = table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at"), table(spark, sf_dir, "clicks")
    return asof_join(sales, clicks, ("sold_at", "ts"), ["client_id"], ["click_id"], "nearest").drop("sold_at")


@query("SELECT lo, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN (VALUES (0, 50000), (50000, 100000), (100000, 200000), (200000, 400000)) b(lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY lo")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the range that holds their price."""
    bounds = spark.createDataFrame([(0, 50000), (50000, 100000), (100000, 200000), (200000, 400000)], "lo int, hi int")
    found = interval_join(table(spark, sf_dir, "orders").select("o_totalprice"), bounds, "o_totalprice", "lo", "hi")
    return found.groupBy("lo").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


SPANS = "SELECT DISTINCT client_id, valid_at AS since, coalesce(lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at), TIMESTAMP '2100-01-01') AS until FROM (SELECT DISTINCT client_id, valid_at FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL)"


@query(f"SELECT sale_id, s.client_id, sold_at, since, until FROM sales s LEFT JOIN ({SPANS}) c ON s.client_id = c.client_id AND sold_at >= since AND sold_at < until")
def interval_sale_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale with the span between two changes of its client in which it lies."""
    times = table(spark, sf_dir, "client_changes").select("client_id", F.col("valid_at").alias("since")).where("client_id is not null and since is not null").distinct()
    spans = times.withColumn("until", F.coalesce(F.lead("since").over(Window.partitionBy("client_id").orderBy("since")), F.expr("timestamp_ntz'2100-01-01'")))
    return interval_join(table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at"), spans, "sold_at", "since", "until", ["client_id"], how="left")


@query("SELECT s.sale_id, count(*) AS clicks, max(k.ts) AS last FROM sales s JOIN clicks k ON s.client_id = k.client_id AND k.ts > s.sold_at - INTERVAL 6 HOUR AND k.ts <= s.sold_at GROUP BY s.sale_id")
def interval_clicks_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of the client in the six hours up to a sale."""
    spans = table(spark, sf_dir, "sales").select("sale_id", "client_id", F.expr("sold_at - interval 6 hours").alias("since"), "sold_at")
    found = interval_join(table(spark, sf_dir, "clicks").select("client_id", "ts"), spans, "ts", "since", "sold_at", ["client_id"], closed="right")
    return found.groupBy("sale_id").agg(F.count("*").alias("clicks"), F.max("ts").alias("last"))


@query("SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY")
def overlap_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer whose 30 days overlap."""
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("a"), F.expr("o_orderdate + interval 30 days").alias("b"))
    others = spans.toDF("o_custkey", "second", "c", "d")
    return overlap_join(spans.withColumnRenamed("o_orderkey", "first"), others, ("a", "b"), ("c", "d"), ["o_custkey"]).where("first < second").select("first", "second")
