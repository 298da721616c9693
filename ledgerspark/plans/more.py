"""More of the registered queries: routing, names and types, JSON, lookups, logs, retrieval, streams as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning, formats, ids, nested, periods, routing, similarity
from ledgerspark.operators import logs, profile, retrieval, statement, structure, text
from ledgerspark.plans import guard, repair, templates, tools
from ledgerspark.plans.registry import passed, query, table
from ledgerspark.sources import json_tables, versioned
from ledgerspark.storage import shared
from ledgerspark.streaming import state


# routing
def _asked(spark: SparkSession, sf_dir: str, rule, name: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rule(F.col("text")).alias(name))


@query(routing.INTENT_SQL.replace("{t}", "conversations"))
def intent_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, routing.intent, "intent")


@query(routing.CHART_SQL.replace("{t}", "conversations"))
def chart_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, routing.chart, "c").select("conv_id", "turn", "c.wants", "c.kind")


@query(routing.REAL_TIME_SQL.replace("{t}", "conversations"))
def real_time_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, routing.real_time, "real_time")


@query(routing.OPERATION_SQL.replace("{t}", "conversations"))
def operation_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, routing.operation, "operation")


@query(routing.KIND_SQL.replace("{t}", "conversations"))
def question_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, routing.question_kind, "kind")


@query(routing.METRIC_SQL.replace("{t}", "conversations"))
def ner_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, routing.metric_categories, "metrics")


#: Questions of every track and intent, from the orders.
ASKED = "CASE o_orderkey % 10 WHEN 0 THEN 'Calculate total revenue for FY' || {yy} WHEN 1 THEN 'Summarize this dataset' WHEN 2 THEN 'What does clause ' || o_custkey || ' say' WHEN 3 THEN 'latest gold price today' WHEN 4 THEN 'tell me a joke' WHEN 5 THEN 'Show me a bar chart comparing sales vs cost' WHEN 6 THEN 'average margin and growth rate' WHEN 7 THEN 'is there any mention of a company name' WHEN 8 THEN 'share of revenue by segment' ELSE 'reconcile the invoice with the po' END"
ASKED_DUCK, ASKED_SPARK = (ASKED.format(yy=y) for y in ("lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0')", "lpad(cast(year(o_orderdate) % 100 as string), 2, '0')"))
QUESTIONS = f"(SELECT o_orderkey AS conv_id, o_custkey AS turn, {ASKED_DUCK} AS text FROM orders)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), F.col("o_custkey").alias("turn"), F.expr(ASKED_SPARK).alias("text"))


@query("SELECT a.conv_id, a.turn, track, intent, wants, kind, tool, real_time FROM (" + ") JOIN (".join(sql.replace("{t}", QUESTIONS) + f") {a}" + (" USING (conv_id, turn)" if a != "a" else "") for a, sql in zip("abcde", (routing.SQL, routing.INTENT_SQL, routing.CHART_SQL, routing.TOOL_SQL, routing.REAL_TIME_SQL), strict=True)).replace(") a) JOIN (", ") a JOIN (").replace("USING (conv_id, turn)) JOIN (", "USING (conv_id, turn) JOIN ("))
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _questions(spark, sf_dir).select("conv_id", "turn", routing.track(t).alias("track"), routing.intent(t).alias("intent"), routing.chart(t).alias("c"), routing.tool(t).alias("tool"), routing.real_time(t).alias("real_time")).select("conv_id", "turn", "track", "intent", "c.wants", "c.kind", "tool", "real_time")


# names, types
@query("SELECT p_partkey, CASE WHEN n = '' THEN 'unnamed' WHEN regexp_matches(n, '^[0-9]') THEN 'col_' || n ELSE n END AS sql_name, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p)), '[^\\p{L}\\p{N}_\\s]', '_', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS sheet_name FROM (SELECT p_partkey, p, regexp_replace(lower(trim(p)), '[^\\p{L}\\p{N}_]', '_', 'g') AS n FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' ' || p_name WHEN 1 THEN ' ' || p_name || ' (%) ' WHEN 2 THEN p_brand || '#' || p_type ELSE '' END AS p FROM part))")
def name_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("case p_partkey % 4 when 0 then p_size || ' ' || p_name when 1 then ' ' || p_name || ' (%) ' when 2 then p_brand || '#' || p_type else '' end")
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.sql_name(given).alias("sql_name"), cleaning.sheet_name(given).alias("sheet_name"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(trim(c), '^[a-zA-Z0-9][a-zA-Z0-9_\\-\\.]{0,127}$') THEN lower(trim(c)) ELSE 'invalid' END AS client FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '../' || c_name WHEN 1 THEN replace(c_name, '#', '-') ELSE c_name END AS c FROM customer)")
def client_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("case c_custkey % 3 when 0 then '../' || c_name when 1 then replace(c_name, '#', '-') else c_name end")
    return table(spark, sf_dir, "customer").select("c_custkey", cleaning.client(given).alias("client"))


ID = "CASE c_custkey % 3 WHEN 0 THEN c_name || ':doc_' || c_custkey || '_ab1:sheet:' || c_nationkey WHEN 1 THEN c_name || ':sheet' ELSE c_name END"


@query(f"SELECT c_custkey, CASE WHEN len(p) >= 2 THEN p[1] END AS client_id, CASE WHEN len(p) >= 3 THEN p[2] END AS doc_id, CASE WHEN len(p) >= 3 THEN array_to_string(p[3:], ':') WHEN len(p) = 2 THEN p[2] ELSE p[1] END AS sheet_name, regexp_extract(d, '(doc_\\d+_[a-f0-9]+)', 1) AS doc FROM (SELECT c_custkey, d, string_split(d, ':') AS p FROM (SELECT c_custkey, {ID} AS d FROM customer))")
def dataset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr(ID)
    return table(spark, sf_dir, "customer").select("c_custkey", ids.parts(given).alias("p"), ids.document_of(given).alias("doc")).select("c_custkey", "p.*", "doc")


@query("SELECT o_orderdate::TIMESTAMP AS \"ordered\", lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS code, round(o_totalprice, 2) AS price, CAST(o_custkey % 50 AS BIGINT) AS units, o_orderstatus AS status FROM orders")
def type_infer_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, ids that only look like numbers, money, whole numbers, categories, all from text."""
    raw = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("code"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"), (F.col("o_custkey") % 50).cast("string").alias("units"), F.col("o_orderstatus").alias("status"))
    return cleaning.inferred(raw)[0].withColumn("ordered", F.col("ordered").cast("timestamp_ntz"))


@query("SELECT o_orderkey AS order_key, round(o_totalprice, 2) AS total_price, '{\"a\":' || o_custkey || '}' AS extra, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'x' END AS mixed FROM orders")
def clean_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For SQL: names, nested values as JSON, numbers only where all values are."""
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Order Key"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total Price"), F.struct(F.col("o_custkey").alias("a")).alias("Extra"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("x").alias("Mixed"))
    return cleaning.registered(raw)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS c FROM orders WHERE o_orderkey % 3 > 0")
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of nulls go."""
    kept = F.col("o_orderkey") % 3 > 0
    holes = table(spark, sf_dir, "orders").select(F.when(kept, F.col("o_orderkey")).alias("o_orderkey"), F.when(kept & (F.col("o_orderkey") % 2 == 0), F.col("o_custkey")).alias("c"), F.lit(None).cast("string").alias("nothing"))
    return cleaning.without_empty(holes)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("case o_orderkey % 4 when 0 then 'N.A.' when 1 then 'Na/p' else o_orderpriority end")
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.without_tokens(given).alias("priority"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def excel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", periods.excel_date(serial.cast("string")).alias("day"))


@query("SELECT o_orderkey, CASE WHEN v = 0 THEN '₹0' WHEN abs(v) >= 10000000 THEN s || '₹' || printf('%.2f', abs(v) / 10000000) || ' crores' WHEN abs(v) >= 100000 THEN s || '₹' || printf('%.2f', abs(v) / 100000) || ' lakhs' WHEN abs(v) >= 1000 THEN s || '₹' || CAST(CAST(floor(abs(v) / 1000) AS BIGINT) AS VARCHAR) || ',' || printf('%06.2f', abs(v) - 1000 * floor(abs(v) / 1000)) ELSE s || '₹' || printf('%.2f', abs(v)) END AS amount FROM (SELECT o_orderkey, o_totalprice * 100 AS v, CASE WHEN o_totalprice < 0 THEN 'negative ' ELSE '' END AS s FROM orders)")
def format_rupees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.rupees(F.col("o_totalprice") * 100).alias("amount"))


@query("SELECT doc_id, coalesce(length(text), 0) // 4 AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", formats.tokens(F.col("text")).alias("tokens"))


@query()
def text_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive; tests compare it on small texts."""
    return table(spark, sf_dir, "documents").select("doc_id", formats.summaries("text").alias("summary"))


@query("SELECT 'n_nationkey: ' || n_nationkey || '; n_name: ' || n_name || '; n_regionkey: ' || n_regionkey AS text FROM nation")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.described(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.markdown_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


LIKE = "standard polished steel"
#: DuckDB: the longest common run of two strings, the first of equals, then what lies before and behind it, until nothing
#: is common; of strings and of their longer words.
SPELLED = """
RECURSIVE pair AS (
    SELECT DISTINCT a, b FROM (
        SELECT '{asked}' AS a, lower(p_type) AS b FROM part
        UNION ALL SELECT x, y FROM (SELECT unnest(string_split('{asked}', ' ')) AS x, y FROM (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS y FROM part)) WHERE length(x) >= 4 AND length(y) >= 4)
), part_of AS (
    SELECT a, b, CAST(0 AS BIGINT) AS m, [{{'al': CAST(1 AS BIGINT), 'ah': CAST(length(a) + 1 AS BIGINT), 'bl': CAST(1 AS BIGINT), 'bh': CAST(length(b) + 1 AS BIGINT)}}] AS todo FROM pair
    UNION ALL
    SELECT a, b, m + k, CASE WHEN k = 0 THEN todo[2:] ELSE todo[2:] || [{{'al': al, 'ah': i, 'bl': bl, 'bh': j}}, {{'al': i + k, 'ah': ah, 'bl': j + k, 'bh': bh}}] END
    FROM (
        SELECT *, coalesce(best[1], 0) AS k, -best[2] AS i, -best[3] AS j FROM (
            SELECT *, list_max(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j:
                       [coalesce(list_max(list_filter(range(1, least(ah - i, bh - j) + 1), lambda k: substr(a, i, k) = substr(b, j, k))), 0), -i, -j])))) AS best
            FROM (SELECT a, b, m, todo, todo[1].al AS al, todo[1].ah AS ah, todo[1].bl AS bl, todo[1].bh AS bh FROM part_of WHERE len(todo) > 0)))
), ratio AS (
    SELECT a, b, 2.0 * max(m) / (length(a) + length(b)) AS r FROM part_of GROUP BY a, b
)
"""
WORDS_IN_COMMON = "SELECT DISTINCT p_type, len(list_intersect({w}, list_distinct(regexp_extract_all(lower(p_type), '\\b\\w{{2,}}\\b')))) AS n, len(list_distinct({w} || regexp_extract_all(lower(p_type), '\\b\\w{{2,}}\\b'))) AS u FROM part"


@query(
    "WITH " + SPELLED.format(asked=LIKE) + ", w AS (" + WORDS_IN_COMMON.format(w=LIKE.split()) + "), t AS (SELECT DISTINCT p_type, lower(p_type) AS b FROM part), "
    f"best AS (SELECT t.p_type, greatest(max(r) FILTER (a = '{LIKE}' AND ratio.b = t.b), 0.75 * coalesce(max(r) FILTER (a <> '{LIKE}' AND r >= 0.8 AND list_contains(string_split(t.b, ' '), ratio.b)), 0)) AS s FROM t, ratio GROUP BY t.p_type) "
    f"SELECT p_partkey, CASE WHEN lower(part.p_type) = '{LIKE}' THEN 1 WHEN contains(lower(part.p_type), '{LIKE}') OR contains('{LIKE}', lower(part.p_type)) THEN 0.95 WHEN s >= 0.55 THEN s ELSE n / u END AS similarity FROM part JOIN best ON best.p_type = part.p_type JOIN w ON w.p_type = part.p_type"
)
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each part's type is to a phrase."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.lit(LIKE).alias("question"))
    return similarity.scored(rows, "question", "p_type", "similarity").select("p_partkey", "similarity")


# JSON
def _document(df: DataFrame) -> DataFrame:
    return df.select(F.struct("*").alias("doc"))


@query("SELECT n_nationkey, n_name FROM nation")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("doc"))
    return json_tables.tables(rows, "nations")[1]["nations"]


@query("SELECT n_nationkey AS key, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def json_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))
    lists = table(spark, sf_dir, "nation").agg(rows.alias("r")).select(F.transform("r", lambda x: x["n_nationkey"]).alias("key"), F.transform("r", lambda x: x["n_name"]).alias("name"), F.transform("r", lambda x: x["n_regionkey"].cast("string")).alias("region"))
    return json_tables.tables(_document(lists), "nations")[1]["nations"]


def _deep(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nations = table(spark, sf_dir, "nation").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("info")))).alias("rows"))
    regions = table(spark, sf_dir, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("regions"))
    made = nations.join(regions, F.lit(True)).select(F.lit("world").alias("title"), F.struct("n", F.struct(F.struct("rows", "regions").alias("lists"), F.lit(1).alias("version")).alias("inner")).alias("data"))
    return json_tables.tables(_document(made), "World Data")[1]


@query("SELECT n_nationkey, n_name AS info_name, n_regionkey AS info_region FROM nation")
def json_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir)["world_data:data_inner_lists_rows"]


@query("SELECT count(*) AS data_n, 1 AS data_inner_version, 'world' AS title FROM nation")
def json_deep_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir)["world_data:overview"]


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props as models write them: in fences, with single quotes, with a comma too many."""
    k = F.get_json_object("props", "$.k")
    bent = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("{'k': "), k, F.lit(",}"))).otherwise(F.concat(F.lit("Here it is, k: "), k))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(repair.tolerant_jsons(bent), "$.k").cast("long").alias("k"))


@query("SELECT n_regionkey, n_name AS nation, 'a' AS a FROM nation WHERE n_regionkey = 1")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose maps hold all of some pairs; maps merged, the later one first."""
    rows = table(spark, sf_dir, "nation").withColumn("meta", nested.merged(F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("a"))))
    return rows.where(nested.holds("meta", {"region": "1", "a": "a"})).select("n_regionkey", F.col("n_name").alias("nation"), F.col("meta")["a"].alias("a"))


# statements and lookups
YEARS = ["1995", "1996", "1997", "1998"]
WIDE = "SELECT o_orderpriority AS particulars, " + ", ".join(f"round(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 2) AS fy{y[2:]}" for y in YEARS) + " FROM orders GROUP BY 1"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement: priorities by fiscal years, called like metrics, in order."""
    labels = F.create_map(*(F.lit(x) for p in {"1": "Revenue", "2": "Cost of goods", "3": "EBITDA", "4": "Net profit", "5": "Inventory"}.items() for x in p))
    sums = (F.round(F.sum(F.when(F.year("o_orderdate") == int(y), F.col("o_totalprice"))), 2).alias(f"fy{y[2:]}") for y in YEARS)
    rows = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("k")).agg(*sums)
    return rows.select(F.col("k").cast("int").alias("row_idx"), labels[F.col("k")].alias("particulars"), *(f"fy{y[2:]}" for y in YEARS))


def _one(spark: SparkSession, name: str, value: object) -> DataFrame:
    return spark.createDataFrame([(None if value is None else float(value),)], f"{name} double")


@query(f"SELECT fy97 AS value FROM ({WIDE}) WHERE particulars LIKE '3%'")
def lookup_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structure.answered(_wide(spark, sf_dir), "What was the EBITDA in FY97?", "row_idx")
    return _one(spark, "value", got and got.value)


@query(f"SELECT round(fy98 - fy96, 2) AS value FROM ({WIDE}) WHERE particulars LIKE '1%'")
def lookup_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structure.answered(_wide(spark, sf_dir), "revenue growth from FY96 to FY98", "row_idx")
    return _one(spark, "value", got and got.value)


@query(f"SELECT round(fy95 + fy96 + fy97 + fy98, 2) AS value FROM ({WIDE}) WHERE particulars LIKE '4%'")
def lookup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structure.answered(_wide(spark, sf_dir), "total net profit", "row_idx")
    return _one(spark, "value", got and got.value)


@query(f"SELECT fy96 AS value FROM ({WIDE}) WHERE particulars LIKE '2%'")
def lookup_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structure.direct_lookup({"data": _wide(spark, sf_dir)}, "what is the cost of goods for fy96", "row_idx")
    return _one(spark, "value", got and got.value)


@query(f"SELECT fy95 AS value FROM ({WIDE}) WHERE particulars LIKE '4%'")
def schema_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir)
    return _one(spark, "value", structure.value_at(df, structure.layout(df, "row_idx"), "net profit", "fy95", "row_idx"))


@query(f"SELECT round((fy98 - fy97) / abs(fy97) * 100, 1) AS growth_pct FROM ({WIDE}) WHERE abs((fy98 - fy97) / abs(fy97) * 100) > 5")
def stmt_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.trends(_wide(spark, sf_dir), "particulars", "fy97", "fy98", "row_idx").select("growth_pct")


@query(f"SELECT CAST(substr(particulars, 1, 1) AS INT) AS row_idx, fy98 AS value FROM ({WIDE})")
def stmt_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir)
    return statement.overview(statement.long(df, "particulars", [c for c in df.columns if c.startswith("fy")], "row_idx")).select("row_idx", "value")


@query(f"SELECT round(fy98 - fy95, 2) AS change FROM ({WIDE})")
def stmt_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir)
    return statement.change(statement.long(df, "particulars", [c for c in df.columns if c.startswith("fy")]), "FY95", "FY98").select("change")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 8 AND 12")
def rows_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement.around(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", 10)


@query("SELECT sum(l_quantity) AS total FROM lineitem")
def template_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question through the template engine."""
    return templates.answered(table(spark, sf_dir, "lineitem"), "What is the total l_quantity?")[0]


@query("SELECT round(avg(o_totalprice), 6) AS result FROM orders")
def lenient_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.lenient(table(spark, sf_dir, "orders"), "avg", "totalprice").select(F.round("result", 6).alias("result"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL through the guard, with a misspelt column that is repaired."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("guarded_orders")
    return guard.run(spark, "WITH big AS (SELECT * FROM guarded_orders WHERE o_totalprice > 100000) SELECT o_orderprioritty AS o_orderpriority, count(*) AS n FROM big GROUP BY 1", {"guarded_orders"})


@query("SELECT CAST(count(*) AS DOUBLE) AS value FROM orders")
def scalar_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, "value", guard.number(table(spark, sf_dir, "orders").agg(F.count("*"))))


# tables, sheets, relations
@query("SELECT round((count(c_custkey) + count(c_name) + count(c_nationkey) + count(c_acctbal) + count(c_mktsegment)) / (count(*) * 5) + least(3 / 5 * 0.2, 0.2) + least(count(*) / 1000, 0.1), 6) AS score FROM customer")
def sheet_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scored_sheet(table(spark, sf_dir, "customer"))


passed("agg_derived", "SELECT c_mktsegment, round(sum(o_totalprice * (1 - 0.1 * (o_custkey % 3))), 1) AS revenue FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment")
passed("win_sliding_tokens", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW), 6) AS tokens FROM {events}")
passed("sql_functions_of_tables", "SELECT id FROM range(0, 50, 7)", "SELECT range AS id FROM range(0, 50, 7)")
passed("rerank_positions", "SELECT n_name, pos FROM (SELECT posexplode(array(7, 3, 11)) AS (pos, idx)) JOIN {nation} ON n_nationkey = idx", "SELECT n_name, CAST(i - 1 AS INT) AS pos FROM (SELECT unnest([7, 3, 11]) AS idx, unnest([1, 2, 3]) AS i) JOIN {nation} ON n_nationkey = idx")
passed("owner_check", "SELECT o_orderkey FROM {orders} LEFT SEMI JOIN (SELECT * FROM {customer} WHERE c_nationkey = 3) c ON o_custkey = c_custkey", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = 3)")
passed("priority_order", "SELECT o_orderkey FROM {orders} ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50")


@query("SELECT event_id, w AS start, w + 10 AS \"end\" FROM (SELECT event_id, unnest([event_id - event_id % 5, event_id - event_id % 5 - 5]) AS w FROM events) WHERE w > event_id - 10")
def udtf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools.register_functions(spark)
    return spark.sql("SELECT event_id, w.start, w.end FROM {events} e, LATERAL windows_of(event_id, 10, 5) w", events=table(spark, sf_dir, "events"))


# logs and metrics
LOG = "SELECT event_id, ts, CASE WHEN event_type <> 'error' AND event_type <> 'view' AND props <> '' OR event_type = 'signup' THEN 'high_value' WHEN value > 50 THEN 'medium_value' ELSE 'low_value' END AS tier, event_type, value FROM events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"), kind.alias("query_text"), F.when(kind != "view", F.col("value")).alias("result"), F.col("props").alias("provenance"), F.when(kind == "error", "error").otherwise("success").alias("status"), F.when(kind == "signup", "sql").alias("analysis_method"), F.when(F.col("value") > 50, F.col("value")).alias("latency_ms"))


@query(f"SELECT event_id AS log_id, event_type AS user_query, CASE WHEN event_type = 'signup' THEN 'sql' END AS method, CAST(day(ts) AS INT) AS day FROM ({LOG}) WHERE tier = 'high_value'")
def log_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.archive(_log(spark, sf_dir)).select("log_id", "user_query", "method", "day")


@query(f"SELECT event_id AS log_id FROM ({LOG}) WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') <= CASE tier WHEN 'high_value' THEN 365 WHEN 'medium_value' THEN 30 ELSE 1 END")
def log_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.purged(_log(spark, sf_dir), F.lit("2024-02-05").cast("timestamp")).select("log_id")


@query("SELECT event_type AS name, props AS tags, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("props").alias("tags"), "value")
    return logs.counters(rows).withColumn("total", F.round("total", 6))


@query("SELECT event_type AS name, '' AS tags, arg_max(value, ts) AS value FROM (SELECT event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type) GROUP BY 1")
def metric_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit("").alias("tags"), "value", F.struct("ts", "event_id").alias("at"))
    return logs.gauges(rows)


@query("SELECT event_type AS method, count(*) AS attempts, count(*) FILTER (value > 50) AS successes, round(count(*) FILTER (value > 50) / count(*), 3) AS success_rate FROM events GROUP BY 1")
def healing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("value") > 50).alias("success"), F.col("value").alias("latency_ms"))
    return logs.success_rates(rows).drop("latency_ms")


@query("SELECT event_type AS method, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def routing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("value").alias("confidence"))
    return routing.routing_rates(rows).drop("confidence")


# retrieval
@query("SELECT md5(html) AS text_md5, min(page_id) AS first_id, count(*) AS copies FROM pages GROUP BY 1 HAVING count(*) > 1")
def dedup_page_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return text.exact_duplicates(pages, F.md5, "text_md5")


@query("SELECT d AS doc_id, page_id AS page, chars, CASE WHEN chars < 1500 AND row_number() OVER (PARTITION BY d, chars < 1500 ORDER BY chars, page_id) <= 20 THEN 'vision' ELSE 'text' END AS route FROM (SELECT page_id % 7 AS d, page_id, length(html) AS chars FROM pages)")
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("doc_id"), F.col("page_id").alias("page"), F.length("html").cast("long").alias("chars"))
    return text.sparse_pages(pages, 1500)


SIGNED = "WITH t AS (SELECT item_id, lower(regexp_replace(text, '^" + text.SPACE_SQL + "+|" + text.SPACE_SQL + "+$', '', 'g')) AS t FROM benchmark), s AS (SELECT DISTINCT item_id, substr(t, i, 3) AS s FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM t WHERE t <> '')), h AS (SELECT item_id, seed, sha256(unhex(printf('%02x000000', seed)) || encode(s)) AS h FROM s, range(128) q(seed)), m AS (SELECT item_id, seed, min(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT)) AS v FROM h GROUP BY 1, 2)"


@query(SIGNED + ", p AS (SELECT a.item_id AS seq, b.item_id AS other, count(*) FILTER (a.v = b.v) / 128 AS similarity FROM m a JOIN m b ON a.seed = b.seed AND b.item_id < a.item_id AND a.item_id - b.item_id <= 500 GROUP BY 1, 2) SELECT seq, min(other) AS dup_of, round(arg_min(similarity, other), 6) AS similarity FROM p WHERE similarity >= 0.3 GROUP BY seq")
def minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.near_before(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), "text"), 0.3)


VECTOR = "SELECT {id}, i, sum(v) AS v FROM (SELECT {id}, CAST('0x' || substr(md5(w[p]), 1, 8) AS BIGINT) % 384 AS i, 1.0::DOUBLE / p AS v FROM (SELECT {id}, w, unnest(range(1, least(len(w), 100) + 1)) AS p FROM {t})) GROUP BY ALL"
FUNNEL_QUESTION = "the coas óas"


def funnel_sql(bm25: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{text.SPACE_SQL}+'), lambda w: w <> '')"
    return (
        "WITH best AS (" + bm25.format(space=text.SPACE_SQL, asked=FUNNEL_QUESTION, k=500) + "), "
        f"few AS (SELECT best.doc_id, score, {words} AS w FROM best JOIN documents d ON d.doc_id = best.doc_id WHERE lang = 'en' ORDER BY score DESC, best.doc_id LIMIT 50), "
        "dv AS (" + VECTOR.format(id="doc_id", t="few") + "), qt AS (SELECT 0 AS q, string_split('" + FUNNEL_QUESTION + "', ' ') AS w), qv AS (" + VECTOR.format(id="q", t="qt") + "), "
        "c AS (SELECT dv.doc_id, coalesce(sum(dv.v * qv.v), 0) / (sqrt(sum(dv.v * dv.v)) * (SELECT sqrt(sum(v * v)) FROM qv)) AS vector_score FROM dv LEFT JOIN qv ON qv.i = dv.i GROUP BY dv.doc_id), "
        "r AS (SELECT few.doc_id, round(vector_score, 8) AS vector_score, round(len(list_intersect(qt.w, few.w)) / len(qt.w), 8) AS rerank_score FROM few JOIN c ON c.doc_id = few.doc_id, qt) "
        "SELECT * FROM r ORDER BY rerank_score DESC, vector_score DESC, doc_id LIMIT 10"
    )


@query()
def funnel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexical = retrieval.search(spark, retrieval.index_of(docs), FUNNEL_QUESTION, text.LEXICAL)
    return text.funnel(docs, FUNNEL_QUESTION, 10, {"lang": "en"}, lexical)


@query("SELECT point_id, version, v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY version DESC, new DESC) AS n FROM (SELECT p_partkey // 4 AS point_id, p_size AS version, p_partkey AS v, p_partkey % 4 // 2 AS new FROM (SELECT min(p_partkey) AS p_partkey, p_size FROM part GROUP BY p_partkey // 4, p_partkey % 4 // 2, p_size))) WHERE n = 1")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as points in two batches, written by bucket; of each point the newest version stays."""
    rows = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 4").alias("point_id"), F.expr("p_partkey % 4 div 2").alias("new"), F.col("p_size").alias("version")).agg(F.min("p_partkey").alias("v"))
    points = versioned.Table(spark, shared(spark, f"points-{uuid.uuid4().hex}"), "point_id", "version", 16)
    for new in (0, 1):
        points.upsert(rows.where(F.col("new") == new).drop("new"))
    return points.rows().select("point_id", "version", "v")


@query("SELECT c_custkey, md5(c_name || ':' || c_nationkey || ':' || c_mktsegment) AS point_id FROM customer")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ids.point_id(F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("point_id"))


# streams, as batches
@query("WITH RECURSIVE e AS (SELECT user_id, ts, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS n FROM events), r AS (SELECT user_id, ts, event_id, n, value <= 120 AS allowed, CASE WHEN value <= 120 THEN 120 - value ELSE 120.0::DOUBLE END AS \"left\" FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.ts, e.event_id, e.n, least(120.0::DOUBLE, r.\"left\" + (epoch(e.ts) - epoch(r.ts)) * 0.001) >= e.value, least(120.0::DOUBLE, r.\"left\" + (epoch(e.ts) - epoch(r.ts)) * 0.001) - CASE WHEN least(120.0::DOUBLE, r.\"left\" + (epoch(e.ts) - epoch(r.ts)) * 0.001) >= e.value THEN e.value ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT CAST(user_id AS VARCHAR) AS client, count(*) FILTER (allowed) AS allowed, count(*) AS n FROM r GROUP BY 1")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("tokens"))
    return state.budgeted(rows, 0.001, 120.0).groupBy("client").agg(F.count_if(F.col("allowed")).alias("allowed"), F.count("*").alias("n"))


@query("SELECT event_type, user_id, min(ts) AS ts FROM events GROUP BY 1, 2")
def requests_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "user_id").alias("key"), "ts", "event_type", "user_id")
    return state.once(rows, "key", "ts").select("event_type", "user_id", "ts")


@query("SELECT event_id AS request_id, CASE WHEN value < 20 THEN 'short' WHEN value < 60 THEN 'medium' ELSE 'long' END AS bucket, CAST((row_number() OVER (PARTITION BY CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END ORDER BY user_id, ts, event_id) - 1) // 8 AS INT) AS batch FROM events")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.when(F.col("value") < 20, 50).when(F.col("value") < 60, 300).otherwise(900)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), tokens.alias("tokens"), F.col("user_id").alias("priority"), F.col("ts").alias("at"))
    return state.batched(rows).select("request_id", "bucket", "batch")
