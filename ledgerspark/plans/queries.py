"""The registered queries on the test tables, each with SQL that another engine can check it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning, nested, periods, routing
from ledgerspark.operators import audit, logs, profile, retrieval, statement, text
from ledgerspark.plans.registry import ORACLE_SQL, QUERIES, TABLES, passed, query, table
from ledgerspark.streaming import events as stream

__all__ = ["ORACLE_SQL", "QUERIES", "TABLES"]


# templates
passed("tpl_sum_column", "SELECT round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS total FROM {lineitem}")
passed("tpl_average_column", "SELECT round(avg(CAST(l_discount AS DOUBLE)), 8) AS average FROM {lineitem}")
passed("tpl_count_rows", "SELECT count(*) AS n FROM {orders}")
passed("tpl_sum_by_period", "SELECT CAST(year(o_orderdate) AS INT) AS period, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1")
passed("tpl_growth_absolute", "SELECT round(sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice END) - sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END), 2) AS growth FROM {orders}")
passed("tpl_variance", "WITH p AS (SELECT sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice END) AS a, sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END) AS b FROM {orders}) SELECT round(a - b, 2) AS variance, round((a - b) / nullif(b, 0) * 100, 2) AS variance_pct FROM p")
passed("tpl_value_at_period", "SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM {orders} WHERE year(o_orderdate) = 1998 AND lower(o_orderpriority) LIKE '%high%' GROUP BY o_orderpriority")

# joins
passed("join_inner", "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
passed("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
passed("join_full", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM {customer} GROUP BY 1) x FULL JOIN (SELECT s_nationkey, count(*) AS s FROM {supplier} GROUP BY 1) y ON c_nationkey = s_nationkey")
passed("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
passed("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
passed("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
passed("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
passed("catalog_semi", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')")

# aggregations
passed("agg_distinct", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem}")
passed("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
passed("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
passed("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
passed("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
passed("agg_filter", "SELECT l_shipdate, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) AS n FROM {lineitem} GROUP BY l_shipdate")
passed("agg_percentile", "SELECT l_returnflag, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM {lineitem} GROUP BY l_returnflag")

# windows, sets, top k
passed("win_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS q FROM {orders}")
passed("win_lag_growth", "SELECT period, total, round(total - lag(total) OVER (ORDER BY period), 2) AS growth FROM (SELECT CAST(year(o_orderdate) AS INT) AS period, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1)")
passed("win_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {orders}")
passed("win_first_match", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM {lineitem}) WHERE rn = 1")
passed("win_sliding_60s", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM {events}")
passed("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
passed("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
passed("set_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier}")
passed("topk_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
passed("topk_per_group", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM {customer}) WHERE rn <= 3")

DIGITS = "WITH d AS (SELECT CAST(regexp_extract(CAST(abs({c}) AS VARCHAR), '[1-9]') AS INT) AS digit, count(*) AS n FROM {t} WHERE {c} <> 0 GROUP BY 1), s AS (SELECT CAST(i AS INT) AS digit, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS share, " + str(audit.EXPECTED) + "[i]::DOUBLE AS expected FROM range(1, 10) r(i) LEFT JOIN d ON d.digit = i)"
VERDICT = ", a AS (SELECT sum(pow(share - expected, 2) / expected) AS distance, count(*) FILTER (abs(share - expected) > 0.02) AS deviations FROM s), b AS (SELECT (SELECT count({c}) FROM {t}) AS n, distance, deviations FROM a) SELECT n, CASE WHEN n >= 100 THEN round(n * distance, 4) END AS chi_square, CASE WHEN n >= 100 THEN deviations END AS deviations, CASE WHEN n < 100 THEN 'warning' WHEN n * distance > 15.51 OR deviations > 2 THEN 'fail' WHEN deviations > 0 THEN 'warning' ELSE 'pass' END AS verdict FROM b"


@query(DIGITS.format(c="l_extendedprice", t="lineitem") + " SELECT digit, n, round(share, 8) AS share, round(expected, 8) AS expected FROM s")
def benford_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.benford_digits(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("digit", "n", F.round("share", 8).alias("share"), F.round("expected", 8).alias("expected"))


@query((DIGITS + VERDICT).format(c="o_totalprice", t="orders"))
def benford_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.benford_verdict(table(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT chi_square FROM (" + (DIGITS + VERDICT).format(c="l_discount", t="lineitem") + ")")
def benford_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a column with zeros, which count in n."""
    return audit.benford_verdict(table(spark, sf_dir, "lineitem"), "l_discount").select("chi_square")


def _cohort_sql(period: str, t: str, user: str, date: str, offset: str) -> str:
    return f"WITH r AS (SELECT DISTINCT {user} AS u, date_trunc('{period}', {date}) AS m FROM {t}), c AS (SELECT *, min(m) OVER (PARTITION BY u) AS first FROM r) SELECT CAST(first AS DATE) AS cohort, CAST({offset} AS INT) AS \"offset\", count(*) AS users FROM c GROUP BY 1, 2"


@query(_cohort_sql("month", "orders", "o_custkey", "o_orderdate", "date_diff('month', first, m)"))
def cohort_counts_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cohorts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query(_cohort_sql("quarter", "orders", "o_custkey", "o_orderdate", "date_diff('quarter', first, m)"))
def cohort_counts_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cohorts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "quarter")


@query(_cohort_sql("week", "events", "user_id", "ts", "date_diff('day', first, m) // 7"))
def cohort_counts_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cohorts(table(spark, sf_dir, "events"), "user_id", "ts", "week")


@query('SELECT *, round(users / first_value(users) OVER (PARTITION BY cohort ORDER BY "offset") * 100, 2) AS retention FROM (' + _cohort_sql("month", "orders", "o_custkey", "o_orderdate", "date_diff('month', first, m)") + ")")
def cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.retention(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    invoices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    orders = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    ledger = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("amount"))
    return audit.three_way_match(invoices, orders, ledger)


MATCH = "WITH p AS (SELECT l_orderkey AS id, round(sum(l_extendedprice), 2) AS po, round(sum(l_extendedprice * (1 - l_discount)), 2) AS ledger FROM lineitem GROUP BY 1), m AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS invoice, po, ledger, coalesce(abs(po - o_totalprice) > abs(o_totalprice) * 0.01, false) AS a, coalesce(abs(ledger - o_totalprice) > abs(o_totalprice) * 0.01, false) AS b FROM orders LEFT JOIN p ON p.id = o_orderkey), s AS (SELECT *, CASE WHEN a AND b THEN 'three_way_mismatch' WHEN a THEN 'invoice_po_mismatch' WHEN b THEN 'invoice_ledger_mismatch' WHEN po IS NULL THEN 'unmatched_po' WHEN ledger IS NULL THEN 'unmatched_ledger' ELSE 'matched' END AS status FROM m)"


@query(MATCH + " SELECT id, status FROM s")
def three_way_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("id", "status")


@query(MATCH + " SELECT status, count(*) AS n FROM s GROUP BY status")
def three_way_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(MATCH + ", c AS (SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status <> 'matched') AS unmatched FROM s) SELECT matched, unmatched, matched + unmatched AS total, round(matched / greatest(matched + unmatched, 1) * 100, 2) AS match_rate, CASE WHEN matched / greatest(matched + unmatched, 1) >= 0.95 THEN 'pass' WHEN matched / greatest(matched + unmatched, 1) >= 0.8 THEN 'warning' ELSE 'fail' END AS verdict FROM c")
def three_way_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.match_verdict(_matched(spark, sf_dir))


@query(MATCH + " SELECT id, status, round(abs(invoice - CASE WHEN status = 'invoice_ledger_mismatch' THEN ledger ELSE po END), 2) AS difference FROM s WHERE status LIKE '%mismatch' ORDER BY id LIMIT 20")
def three_way_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.discrepancies(_matched(spark, sf_dir))


def _statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.year("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


STATEMENT = "WITH s AS (SELECT o_orderpriority AS label, CAST(year(o_orderdate) AS INT) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"


@query(STATEMENT + " SELECT * FROM s")
def stmt_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement(spark, sf_dir)


@query(STATEMENT + " SELECT *, lag(value) OVER (PARTITION BY label ORDER BY period) AS before, round((value - lag(value) OVER (PARTITION BY label ORDER BY period)) / abs(lag(value) OVER (PARTITION BY label ORDER BY period)) * 100, 2) AS growth_pct FROM s")
def stmt_growth_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement.growth(_statement(spark, sf_dir))


@query(STATEMENT + " SELECT label, round(sum(value), 2) AS total, count(*) FILTER (value <> 0) AS periods FROM s GROUP BY label")
def stmt_row_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement.row_total(_statement(spark, sf_dir)).withColumn("total", F.round("total", 2))


@query(STATEMENT + " SELECT label, max(period) AS period, arg_max(value, period) AS value FROM s WHERE value <> 0 GROUP BY label")
def stmt_latest_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement.latest(_statement(spark, sf_dir))


@query(STATEMENT + " SELECT label, sum(value) FILTER (period = 1996) AS p1996, sum(value) FILTER (period = 1997) AS p1997 FROM s GROUP BY label")
def stmt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement.wide(_statement(spark, sf_dir), [1996, 1997])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
each = lambda sql: " UNION ALL ".join(sql.format(c=c) for c in NUMBERS)


MICRO = "sum(CAST(round({c} * 1000000) AS HUGEINT))"


@query(each("SELECT '{c}' AS \"column\", count({c}) AS non_null, round((1 - count({c}) / count(*)) * 100, 2) AS null_pct, min({c}) AS low, max({c}) AS high, sign(" + MICRO + ") * ((2 * abs(" + MICRO + ") + count({c})) // (2 * count({c}))) / 1000000.0::DOUBLE AS mean, count(DISTINCT {c}) AS \"distinct\" FROM lineitem"))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.columns(table(spark, sf_dir, "lineitem"), NUMBERS)


@query(each("SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM lineitem"))
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shape(table(spark, sf_dir, "lineitem"), NUMBERS)


OUT = each("SELECT '{c}' AS \"column\", q1, q3, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS low, count(*) FILTER ({c} > q3 + 1.5 * (q3 - q1)) AS high FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q3")


@query(f'SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, low, high FROM ({OUT})')
def profile_outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.outliers(table(spark, sf_dir, "lineitem"), NUMBERS).select("column", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "low", "high")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def profile_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlations(table(spark, sf_dir, "lineitem"), NUMBERS)


@query(" UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT 3)" for c in ("l_returnflag", "l_linestatus")))
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


FREE = each("SELECT '{c}' AS \"column\", round(count({c}) / count(*) * 100, 1) AS completeness, 100.0::DOUBLE AS consistency, CASE WHEN count({c}) >= 4 AND q3 > q1 THEN round((1 - count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c})) * 100, 1) ELSE 100.0::DOUBLE END AS outlier_free FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q3")
FLAG = "SELECT 'l_returnflag' AS \"column\", round(count(l_returnflag) / count(*) * 100, 1) AS completeness, round(greatest(count(TRY_CAST(l_returnflag AS DOUBLE)) / count(l_returnflag), 1 - count(TRY_CAST(l_returnflag AS DOUBLE)) / count(l_returnflag)) * 100, 1) AS consistency, 100.0::DOUBLE AS outlier_free FROM lineitem"
QUALITY = f"SELECT *, round(completeness * 0.5 + consistency * 0.25 + outlier_free * 0.25, 1) AS quality FROM ({FREE} UNION ALL {FLAG})"


@query(QUALITY)
def profile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quality(table(spark, sf_dir, "lineitem"), [*NUMBERS, "l_returnflag"])


@query(f"WITH g AS (SELECT CAST((2 * sum(CAST(round(quality * 10) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS quality, CAST((2 * sum(CAST(round(completeness * 10) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS completeness FROM ({QUALITY})) SELECT *, CASE WHEN quality >= 90 THEN 'A' WHEN quality >= 75 THEN 'B' WHEN quality >= 60 THEN 'C' ELSE 'D' END AS grade FROM g")
def profile_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.grade(profile.quality(table(spark, sf_dir, "lineitem"), [*NUMBERS, "l_returnflag"]))


@query("WITH o AS (SELECT o_orderkey AS row, round(o_totalprice, 2) AS value, CASE WHEN o_totalprice < q1 - 0.2 * (q3 - q1) THEN 'LOW' WHEN o_totalprice > q3 + 0.2 * (q3 - q1) THEN 'HIGH' END AS dir FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)) SELECT 'o_totalprice' AS \"column\", row, value, dir FROM o WHERE dir IS NOT NULL ORDER BY row, value LIMIT 5")
def profile_outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.outlier_rows(table(spark, sf_dir, "orders"), ["o_totalprice"], "o_orderkey", fence=0.2)


@query("SELECT \"column\", skew, kurtosis, CASE WHEN abs(skew) < 0.5 THEN 'symmetric' WHEN skew > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape, CASE WHEN kurtosis > 3 THEN 'heavy-tailed' WHEN kurtosis < -1 THEN 'light-tailed' ELSE 'normal-tailed' END AS tail FROM (" + ORACLE_SQL["profile_shape"] + ")")
def profile_shape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.labelled_shape(table(spark, sf_dir, "lineitem"), NUMBERS)


MIXED = "(SELECT l_quantity, l_extendedprice + 900 * l_quantity AS l_extendedprice, l_discount, l_tax - l_discount AS l_tax FROM lineitem)"


@query("SELECT a, b, round(r, 3) AS r, CASE WHEN abs(r) > 0.8 THEN 'strong' ELSE 'moderate' END AS strength FROM (" + ORACLE_SQL["profile_correlations"].replace("FROM lineitem", "FROM " + MIXED) + ") WHERE abs(r) > 0.5 ORDER BY abs(r) DESC LIMIT 5")
def profile_strong_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On columns that depend on each other."""
    mixed = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") + 900 * F.col("l_quantity")).alias("l_extendedprice"), "l_discount", (F.col("l_tax") - F.col("l_discount")).alias("l_tax"))
    return profile.strong_correlations(mixed, NUMBERS)


# cleaning
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS amount FROM orders")
def clean_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.format_number("o_totalprice", 2)
    dirty = F.when(F.col("o_orderkey") % 7 == 0, " N/A ").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit("$"), shown))
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.currency(dirty).alias("amount"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN 'col_' || n ELSE n END AS name FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM part)")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.safe_name(F.col("p_name")).alias("name"))


PLAIN_ID = "regexp_replace(regexp_replace(regexp_replace(translate(trim(lower({c})), ' -:/\\', '_____'), '[^a-z0-9_.]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
TENANT = f"coalesce(nullif({PLAIN_ID}, ''), 'default_client')"


@query("SELECT c_custkey, " + TENANT.format(c="c_name") + " AS tenant FROM customer")
def tenant_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", cleaning.tenant(F.col("c_name")).alias("tenant"))


# texts and vectors
@query("SELECT sha256(text) AS text_sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exact_duplicates(table(spark, sf_dir, "documents"))


@query("SELECT item_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(text, i, 3)))) END AS n FROM benchmark")
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(text.shingles(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


@query()
def shingles_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for all documents, 0 for an empty text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.shingles(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


HASHED = "SELECT w, CAST('0x' || substr(md5(w), 25, 8) AS BIGINT) AS lo, CAST('0x' || substr(md5(w), 17, 8) AS BIGINT) AS hi"
#: DuckDB: 64 votes of words between white space, in two halves.
SIMHASH = "WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '" + text.SPACE_SQL + "+'), lambda w: w <> '')) AS w FROM documents), k AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), h AS (" + HASHED + ", doc_id, n FROM k), v AS (SELECT doc_id, sum(n) AS n, " + ", ".join(f"sum(n * (({x} >> {i}) & 1)) AS {x}{i}" for x in ("lo", "hi") for i in range(32)) + " FROM h GROUP BY doc_id), s AS (SELECT doc_id, " + ", ".join("(" + " + ".join(f"CASE WHEN 2 * {x}{i} > n THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32)) + f") AS {x}" for x in ("lo", "hi")) + " FROM v), f AS (SELECT d.doc_id, coalesce(CASE WHEN hi >= 2147483648 THEN hi - 4294967296 ELSE hi END * 4294967296 + lo, 0)::BIGINT AS simhash FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id)"


@query(SIMHASH + " SELECT * FROM f")
def text_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.fingerprints(table(spark, sf_dir, "documents"))


@query(SIMHASH + ", c AS (SELECT simhash, min(doc_id) AS doc_id FROM f GROUP BY simhash) SELECT c.doc_id AS a, f.doc_id AS b, 0 AS distance FROM f JOIN c ON f.simhash = c.simhash WHERE f.doc_id <> c.doc_id UNION ALL SELECT a.doc_id, b.doc_id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) FROM c a JOIN c b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.simhash, b.simhash)) <= 3")
def simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.close_fingerprints(text.fingerprints(table(spark, sf_dir, "documents")))


#: A common word, which most texts of one language hold, and rarer ones.
ASKED = "the of the coas óas"
#: DuckDB: Okapi with the floor for words that more than half of all texts hold.
BM25 = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{space}+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
d AS (SELECT term, count(*) AS d FROM (SELECT unnest(list_distinct(w)) AS term FROM t) GROUP BY term),
i AS (SELECT term, ln(docs - d + 0.5) - ln(d + 0.5) AS idf FROM d, n),
g AS (SELECT avg(idf) AS idf FROM i),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split('{asked}', ' ')) AS term) GROUP BY term),
z AS (SELECT q.term, times, CASE WHEN i.idf < 0 THEN 0.25 * g.idf ELSE i.idf END AS idf FROM q JOIN i ON i.term = q.term, g),
r AS (SELECT doc_id, sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM (SELECT doc_id, len(w) AS len, z.*, len(list_filter(w, lambda x: x = z.term)) AS f FROM t, z), n WHERE f > 0 GROUP BY doc_id)
SELECT doc_id, round(score, 8) AS score FROM r WHERE round(score, 8) > 0 ORDER BY round(score, 8) DESC, doc_id LIMIT {k}
"""


@query(BM25.format(space=text.SPACE_SQL, asked=ASKED, k=10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(spark, retrieval.index_of(table(spark, sf_dir, "documents")), ASKED)


@query("WITH q AS (SELECT list_transform(range(1, 65), lambda i: CASE WHEN i <= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 8) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.cosine(table(spark, sf_dir, "embeddings"), [1.0] * 4 + [0.0] * 60)


@query("SELECT doc_id, CAST(c AS INT) AS chunk, substr(text, CAST(c AS BIGINT) * 700 + 1, 800) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) // 700 + 1)) AS c FROM documents WHERE text <> '')")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunks(table(spark, sf_dir, "documents"))


STRIPPED = "regexp_replace({x}, '^" + text.SPACE_SQL.replace("{", "{{").replace("}", "}}") + "+|" + text.SPACE_SQL.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"
#: DuckDB: paragraphs one by one.
PROSE = (
    "WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n" + text.SPACE_SQL + "*\\n'), lambda x: " + STRIPPED.format(x="x") + "), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL), "
    "r AS (SELECT doc_id, p, 1 AS i, '' AS now, CAST(NULL AS VARCHAR) AS made, 0 AS n FROM p UNION ALL SELECT doc_id, p, i + 1, CASE WHEN length(now) + length(p[i]) > 500 THEN right(now, 50) || ' ' || p[i] ELSE "
    + STRIPPED.format(x="now || chr(10) || chr(10) || p[i]") + " END, CASE WHEN length(now) + length(p[i]) > 500 AND length(now) >= 100 THEN " + STRIPPED.format(x="now") + " END, n + CASE WHEN length(now) + length(p[i]) > 500 AND length(now) >= 100 THEN 1 ELSE 0 END FROM r WHERE i <= len(p)) "
    "SELECT doc_id, CAST(n - 1 AS INT) AS chunk, made AS text FROM r WHERE made IS NOT NULL UNION ALL SELECT doc_id, CAST(n AS INT), " + STRIPPED.format(x="now") + " FROM r WHERE i = len(p) + 1 AND length(now) >= 100"
)


@query(PROSE)
def chunk_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.paragraphs(table(spark, sf_dir, "documents"))


#: DuckDB: lines one by one, each chunk headed by the first line.
LINES = (
    "WITH RECURSIVE l AS (SELECT doc_id, string_split(" + STRIPPED.format(x="text") + ", chr(10)) AS l FROM documents WHERE text IS NOT NULL), "
    "r AS (SELECT doc_id, l, 2 AS i, l[1] AS now, length(l[1]) AS size, 1 AS parts, CAST(NULL AS VARCHAR) AS made, 0 AS n FROM l UNION ALL SELECT doc_id, l, i + 1, CASE WHEN size + length(l[i]) > 500 THEN l[1] ELSE now END || chr(10) || l[i], "
    "CASE WHEN size + length(l[i]) > 500 THEN length(l[1]) ELSE size END + length(l[i]), CASE WHEN size + length(l[i]) > 500 THEN 2 ELSE parts + 1 END, CASE WHEN size + length(l[i]) > 500 AND size >= 100 THEN now END, n + CASE WHEN size + length(l[i]) > 500 AND size >= 100 THEN 1 ELSE 0 END FROM r WHERE i <= len(l)) "
    "SELECT doc_id, CAST(n - 1 AS INT) AS chunk, made AS text FROM r WHERE made IS NOT NULL UNION ALL SELECT doc_id, CAST(n AS INT), now FROM r WHERE i = len(l) + 1 AND parts > 1"
)


@query(LINES)
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.table_chunks(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND source = 'src1'")
def meta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where((F.col("lang") == "fr") & (F.col("source") == "src1")).select("doc_id", "lang")


LETTERS = r"regexp_replace(text, '[^\p{L}]', '', 'g')"
NOT_LATIN = f"coalesce(length({LETTERS}) - length(regexp_replace({LETTERS}, '{text.OTHER}', '', 'g')) > 0.1 * length({LETTERS}), false)"


@query(f"SELECT doc_id, {NOT_LATIN} AS non_english FROM documents")
def non_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.non_english(F.col("text")).alias("non_english"))


@query("WITH RECURSIVE i AS (SELECT conv_id AS g, turn AS id, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), r AS (SELECT DISTINCT g, 0::BIGINT AS n, 0::BIGINT AS used, []::BIGINT[] AS ids FROM i UNION ALL SELECT r.g, i.n, CASE WHEN used + size <= 400 THEN used + size ELSE used END, CASE WHEN used + size <= 400 THEN list_append(ids, i.id) ELSE ids END FROM r JOIN i ON i.g = r.g AND i.n = r.n + 1) SELECT g AS \"group\", arg_max(ids, n) AS ids, arg_max(used, n) AS used FROM r GROUP BY g")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("rank"), F.col("turn").alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return text.packed_to_budget(items, 400)


# routing, events
@query(routing.SQL.replace("{t}", "conversations"))
def route_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.track(F.col("text")).alias("track"))


@query("SELECT conv_id, turn, " + periods.periods_sql("coalesce(text, '')") + " AS periods FROM conversations")
def ner_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(table(spark, sf_dir, "conversations").select("conv_id", "turn", periods.periods(F.col("text")).alias("periods")))


def _kinds(found: DataFrame) -> DataFrame:
    return found.withColumn("periods", F.transform("periods", lambda p: F.concat(p["kind"], F.lit(":"), p["normalized"])))


#: Texts with periods in every spelling, from the orders' dates.
SPOKEN = "CASE o_orderkey % 8 WHEN 0 THEN 'Revenue for Q' || {q} || ' FY' || {yy} WHEN 1 THEN 'H1 FY ' || chr(39) || {yy} || ' vs 9MFY' || {yy} WHEN 2 THEN 'fiscal year ' || {y} || ', quarter ' || {q} WHEN 3 THEN 'as of ' || {d} WHEN 4 THEN 'March-' || {yy} || ' and sept ' || {y} WHEN 5 THEN 'CY' || {y} || ' Q' || {q} || ' ' || {yy} WHEN 6 THEN 'YTD FY' || {yy} || ' to 01/02/' || {y} ELSE 'nothing here' END"


@query("SELECT o_orderkey, " + periods.periods_sql("t") + " AS periods FROM (SELECT o_orderkey, " + SPOKEN.format(q="quarter(o_orderdate)", y="year(o_orderdate)", yy="lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0')", d="strftime(o_orderdate, '%Y-%m-%d')") + " AS t FROM orders)")
def ner_periods_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = F.expr(SPOKEN.format(q="quarter(o_orderdate)", y="year(o_orderdate)", yy="lpad(cast(year(o_orderdate) % 100 as string), 2, '0')", d="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return _kinds(table(spark, sf_dir, "orders").select("o_orderkey", periods.periods(spoken).alias("periods")))


passed("json_props", "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM {events} GROUP BY event_type", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM {events} GROUP BY event_type")


@query("SELECT c_custkey, '<MASKED>' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.masked(table(spark, sf_dir, "customer"))


@query("SELECT event_type, count(*) AS n, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1], 6) AS p95 FROM events GROUP BY event_type")
def hist_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.histogram(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.col("count").alias("n"), F.round("p95", 6).alias("p95"))


@query('SELECT event_type, count(value) AS "count", min(value) AS "min", max(value) AS "max", ' + ", ".join(f"list_sort(list(value))[least(CAST(floor(count(value) * {s}) AS BIGINT), count(value) - 1) + 1] AS {p}" for p, s in logs.SHARES.items()) + " FROM events GROUP BY event_type")
def hist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.histogram(table(spark, sf_dir, "events"), "event_type", "value").drop("mean")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.counts_by_window(table(spark, sf_dir, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# more of joins, cohorts, statements, cleaning, texts, logs
passed("catalog_anti", "SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 45)")
PRIOR = "SELECT event_id, {last} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value FROM {{events}}"
passed("join_asof_prior", PRIOR.format(last="last_value(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS").replace("{{", "{").replace("}}", "}"), PRIOR.format(last="last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)").replace("{{", "{").replace("}}", "}"))
passed("cohort_first", "SELECT o_custkey, CAST(min(date_trunc('month', o_orderdate)) AS DATE) AS cohort FROM {orders} GROUP BY o_custkey")


@query(f'SELECT "offset", CAST((2 * sum(CAST(round(retention * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS retention FROM ({ORACLE_SQL["cohort_retention"]}) WHERE "offset" > 0 GROUP BY "offset"')
def cohort_avg_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.average_retention(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("SELECT cohort, " + ", ".join(f'max(users) FILTER ("offset" = {i}) AS p{i}' for i in range(6)) + " FROM (" + ORACLE_SQL["cohort_counts_quarter"] + ") GROUP BY cohort")
def cohort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cohort_matrix(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "quarter", 6)


@query("WITH r AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate) AS m FROM orders), c AS (SELECT *, min(m) OVER (PARTITION BY u) AS first FROM r) SELECT CAST(first AS DATE) AS cohort, CAST(date_diff('day', first, m) // 30 AS INT) AS \"offset\", count(DISTINCT u) AS users FROM c GROUP BY 1, 2")
def cohort_counts_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cohorts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", by="days")


@query("WITH r AS (SELECT o_custkey AS u, date_trunc('quarter', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), c AS (SELECT *, min(m) OVER (PARTITION BY u) AS first FROM r) SELECT CAST(first AS DATE) AS cohort, CAST(date_diff('quarter', first, m) AS INT) AS \"offset\", round(sum(v), 2) AS value FROM c GROUP BY 1, 2")
def cohort_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cohort_values(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "quarter").withColumn("value", F.round("value", 2))


LABELS = {"1": "Revenue", "2": "Gross Profit", "3": "EBITDA", "4": "Net Profit", "5": "Interest Expense"}


@query("WITH s AS (SELECT CAST(year(o_orderdate) AS INT) AS period, " + ", ".join(f"round(sum(o_totalprice) FILTER (substr(o_orderpriority, 1, 1) = '{k}'), 2) AS v{k}" for k in LABELS) + " FROM orders GROUP BY 1) SELECT period, round_even(v2 / v1 * 100, 2) AS gross_margin, round_even(v3 / v1 * 100, 2) AS ebitda_margin, round_even(v4 / v1 * 100, 2) AS net_margin, round_even(v3 / v5, 2) AS interest_coverage FROM s")
def stmt_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return statement.ratios(_statement(spark, sf_dir).withColumn("label", named[F.substring("label", 1, 1)]))


@query("SELECT CAST(o_orderkey AS DOUBLE) AS order_id, round(o_totalprice, 2) AS total_price, o_orderstatus AS status FROM orders")
def type_infer_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("Order Id"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total Price"), F.col("o_orderstatus").alias("Status"))
    return cleaning.cleaned(raw)


@query("SELECT n_regionkey AS id, array_to_string(list_transform(list_sort(list(n_nationkey))[1:10], lambda x: CAST(x AS VARCHAR)), ', ') AS keys, '[' || count(*) || ' records]' AS nations, min(n_name) AS info_first, max(n_name) AS info_last FROM nation GROUP BY 1")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"), F.collect_list(F.struct("n_name")).alias("nations"), F.struct(F.min("n_name").alias("first"), F.max("n_name").alias("last")).alias("info"))
    return nested.flattened(rows)


@query("SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, '[\\t|]'))) + len(list_filter(l, lambda x: regexp_matches(x, '[0-9]+\\s+[0-9]+\\s+[0-9]+'))) > 3 THEN 'table' ELSE 'prose' END AS content_type FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10))[1:10] AS l FROM documents)")
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_type(F.col("text")).alias("content_type"))


@query(f"SELECT doc_id, round((contains(lower(text), 'that')::INT + contains(lower(text), 'than')::INT + contains(lower(text), 'market')::INT) / 3, 8) AS score FROM documents WHERE NOT {NOT_LATIN} AND score >= 0.2 ORDER BY score DESC, doc_id LIMIT 10")
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.relevant(table(spark, sf_dir, "documents"), "what is that market than", k=10)


@query("WITH s AS (SELECT DISTINCT item_id, substr(text, i, 3) AS s FROM benchmark, range(1, 100000) r(i) WHERE i <= greatest(length(text) - 2, 1) AND text <> ''), h AS (SELECT item_id, seed, sha256(unhex(printf('%02x000000', seed)) || encode(s)) AS h FROM s, range(16) q(seed)), m AS (SELECT item_id, seed, min(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT)) AS v FROM h GROUP BY 1, 2) SELECT item_id, list(v ORDER BY seed) AS signature FROM m GROUP BY 1")
def minhash_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.minhash(table(spark, sf_dir, "benchmark").where("text <> ''"), "item_id", 16)


@query()
def minhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 128 permutations, empty texts too."""
    return text.minhash(table(spark, sf_dir, "documents"), "doc_id")


@query(routing.TOOL_SQL.replace("{t}", "conversations"))
def tool_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.tool(F.col("text")).alias("tool"))


@query("SELECT event_id, CASE WHEN (event_type <> '' AND event_type <> 'view' AND props <> '' AND event_type <> 'error') OR event_type = 'signup' THEN 'high_value' WHEN value > 50 THEN 'medium_value' ELSE 'low_value' END AS tier FROM events")
def log_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select("event_id", kind.alias("query_text"), F.when(kind != "view", F.col("value")).alias("result"), F.col("props").alias("provenance"), F.when(kind == "error", "error").otherwise("success").alias("status"), F.when(kind == "signup", "sql").alias("method"), F.when(F.col("value") > 50, F.col("value")).alias("latency_ms"))
    return logs.tier(log).select("event_id", "tier")


from ledgerspark.plans import more, ordered, parts, stored  # noqa: E402, F401  the other queries

ORACLE_SQL["funnel_topk"] = more.funnel_sql(BM25)
