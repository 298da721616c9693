"""Small inputs whose results are known."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning, formats, ids, periods, routing, similarity
from ledgerspark.operators import audit, charts, logs, profile, statement, structure, text
from ledgerspark.plans import guard, repair, templates, tools

YEARS = {
    "Revenue": (10000000, 12000000),
    "Cost of Goods Sold": (6000000, 7000000),
    "Gross Profit": (4000000, 5000000),
    "Operating Expenses": (1500000, 1800000),
    "EBITDA": (2500000, 3200000),
    "Depreciation": (500000, 600000),
    "Interest Expense": (200000, 180000),
    "Profit Before Tax": (1800000, 2420000),
    "Tax Expense": (450000, 605000),
    "Net Profit": (1350000, 1815000),
}


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame([(i, k, a, b) for i, (k, (a, b)) in enumerate(YEARS.items())], "row_idx int, particulars string, FY2023 long, FY2024 long").cache()


@pytest.fixture(scope="module")
def wide(spark):
    kinds = ["revenue", "cost", "margin", "expense", "profit", "volume", "discount", "tax", "fee", "rate"]
    names = [f"{kinds[i % 10]}_{i:02d}" for i in range(96)]
    row = (datetime.date(2020, 1, 31), "c1", "n1", "p1", *([1.0] * 96))
    return spark.createDataFrame([row] * 3, "Date_Period date, Customer_ID string, Customer_Name string, Product_Category string, " + ", ".join(f"{n} double" for n in names))


def test_statement(sheet):
    assert guard.scalar(sheet.agg(F.sum("FY2023"))) == 28300000
    long = statement.long(sheet, "particulars", ["FY2023", "FY2024"], "row_idx")
    row = next(r for r in statement.ratios(long).collect() if r.period == "FY2024")
    assert (row.gross_margin, row.ebitda_margin, row.net_margin, row.interest_coverage) == (41.67, 26.67, 15.12, 17.78)
    grown = {r.label: r.growth_pct for r in statement.growth(long.select("label", "period", "value")).collect() if r.period == "FY2024"}
    assert grown["Revenue"] == 20.0
    assert {r.label: r.change for r in statement.change(long, "fy2023", "FY2024").collect()}["EBITDA"] == 700000


def test_lookups(sheet):
    plan = structure.layout(sheet, "row_idx")
    assert plan.label == "particulars" and plan.periods["fy2024"] == "FY2024"
    assert structure.value_at(sheet, plan, "revenue", "fy2024", "row_idx") == 12000000
    assert structure.value_at(sheet, plan, "revenue", "fy2030", "row_idx") is None
    ask = lambda q: structure.answered(sheet, q, "row_idx")
    assert ask("What was the EBITDA in FY2024?").value == 3200000
    assert ask("growth of net profit from FY2023 to FY2024").value == 465000
    assert ask("total tax expense").value == 1055000
    assert ask("give me a summary").method == "summary"
    assert structure.direct_lookup({"x:pl": sheet}, "what is the gross profit in 2024", "row_idx").value == 5000000
    assert structure.direct_lookup({"x:pl": sheet}, "hello there", "row_idx") is None
    assert structure.metric_row(sheet, "particulars", "interest expense", "row_idx").label == "Interest Expense"
    told = structure.row_centric(sheet.drop("row_idx"))
    assert told["is_row_centric"] and told["period_columns"] == ["FY2023", "FY2024"]
    assert [r.row_idx for r in statement.around(sheet, "row_idx", 1).collect()] == [0, 1, 2, 3]
    assert tools.cascade(sheet, "What was the EBITDA in FY2024?", "row_idx")[1] in ("direct_lookup", "statement")


def test_datasets(spark, sheet):
    other = spark.createDataFrame([("Acme Industries Pvt Ltd", 1.0)], "title string, x double")
    frames = {"f:profit_loss": sheet, "f:cover": other, "g:misc": other}
    assert structure.dataset_scores("net profit for FY2024", [(k, v.columns) for k, v in frames.items()])[0][0] == "f:profit_loss"
    assert structure.dataset_scores("show data from the cover sheet", [(k, v.columns) for k, v in frames.items()])[0][0] == "f:cover"
    assert structure.related_sheets("profit before tax", "f:cover", frames)[0][0] == "f:profit_loss"
    assert structure.entities({"f:cover": other})[0][0] == "Acme Industries Pvt Ltd"


def test_schema_filter(wide, sheet):
    small = structure.filtered_schema(sheet, "What is the revenue?")
    assert small["compression_ratio"] == 1.0
    big = structure.filtered_schema(wide, "What is the total revenue for this customer?")
    assert big["total_columns"] == 100 and big["filtered_columns"] <= 20 and big["compression_ratio"] < 0.5
    typo = structure.relevant_columns(wide.columns, "what is the revnue total")
    assert any("revenue" in c for c in typo) and "Date_Period" in typo
    assert len(structure.relevant_columns([f"obscure_col_{i}" for i in range(50)], "zzz")) >= 5
    assert "Examples" in big["schema_string"]
    assert formats.relevant_columns("total revenue", ["x", "revenue_fy", "tax"], 1) == ["revenue_fy"]


def test_similarity():
    assert similarity.similarity("Net_Sales", "net sales") == 1.0
    assert similarity.similarity("sales", "net sales") == 0.95
    assert similarity.similarity("revnue", "revenue") >= 0.85
    assert similarity.similarity("PAT", "profit after tax") == 0.92
    assert similarity.similarity("zebra", "quark") < 0.3
    assert similarity.in_full("FCF growth") == "free cash flow growth"
    assert "turnover" in similarity.expanded("total revenue")
    assert similarity.best_match("revenue", ["tax", "revenue from operations"])[0] == "revenue from operations"
    assert similarity.best_match("qqq", ["tax"]) is None
    assert similarity.all_matches("revenue", ["net revenue", "tax", "revenue"])[0] == ("revenue", 1.0)


def test_exemplars(spark):
    q = spark.createDataFrame([("list the sheets",), ("total revenue",), (None,)], "text string")
    got = {r.text: r.intent for r in similarity.nearest_exemplar(q, [("metadata", "list sheets"), ("analysis", "calculate total revenue")]).collect()}
    assert got == {"list the sheets": "metadata", "total revenue": "analysis", None: "unknown"}


def test_periods():
    kinds = lambda t: [(n, k) for _, n, k in periods.found(t)]
    assert ("9mfy23", "partial_year") in kinds("for 9MFY23") and ("h1fy24", "half_year") in kinds("H1 FY24")
    assert kinds("fiscal year 2023") == [("fy2023", "fiscal_year"), ("2023", "year")]
    assert ("dec_2022", "date") in kinds("at 2022-12-31") and ("mar23", "month") in kinds("Mar'23")
    assert periods.column_kind("Q1_FY22") == "quarter" and periods.column_kind("2021") == "year" and periods.column_kind("x") is None
    assert periods.in_question("Total for FY21 and q2fy22, January 2023") == ["fy21", "fy22", "q2fy22", "january"]
    assert periods.month_column("value in January 2023", ["feb_23", "jan_23"]) == "jan_23"
    assert periods.month_column("value in Mar 99", ["mar_2099", "mar-1999"]) == "mar-1999"
    assert periods.excel_date_of(44927) == datetime.date(2023, 1, 1)


def test_routing(spark):
    q = ["Calculate total revenue for FY23", "Summarize this dataset", "clause 7 of it", "latest gold price", "tell me a joke", "hm"]
    rows = spark.createDataFrame([(x,) for x in q], "t string").select(routing.track(F.col("t")).alias("a"), routing.track(F.col("t"), False).alias("b")).collect()
    assert [r.a for r in rows] == ["TRACK_DATA", "TRACK_DOC_SUMMARY", "TRACK_DOC", "TRACK_WEB", "TRACK_OUT_OF_DOMAIN", None]
    assert rows[0].b is None and rows[1].b == "TRACK_DOC_SUMMARY"
    s = lambda t: routing.parsed(t)["strategy"]
    assert s("summarize it")["lookup_type"] == "summary" and s("total revenue for FY23")["lookup_type"] == "aggregation"
    assert s("revenue growth from FY22 to FY23")["lookup_type"] == "comparison" and s("revenue in 2023")["lookup_type"] == "cell"
    assert s("inventory please")["lookup_type"] == "row" and s("in 2023")["lookup_type"] == "column" and s("hm")["llm_required"]


@pytest.mark.parametrize("sql", ["DROP TABLE data", "SELECT * FROM data; DROP TABLE users", "DELETE FROM data WHERE 1=1", "INSERT INTO data VALUES (1,2,3)", "ALTER TABLE data ADD COLUMN x", "UPDATE data SET revenue = 0", "", "SELECT 1 -- x", "SELECT 1; SELECT 2"])
def test_guard_refuses(sql):
    with pytest.raises(guard.Refused):
        guard.sanitized(sql)


def test_guard(spark):
    assert guard.sanitized("SELECT revenue FROM data WHERE year = 2023;") == "SELECT revenue FROM data WHERE year = 2023"
    assert guard.sanitized("SELECT 'a -- b; DROP TABLE x' FROM data")
    assert guard.check(spark, "WITH a AS (SELECT * FROM data) SELECT * FROM a JOIN data USING (x)", {"data"})
    assert guard.check(spark, "EXPLAIN SELECT EXTRACT(year FROM d) FROM data", {"data"})
    for sql in ("SELECT * FROM other", "SELECT * FROM data WHERE x IN (SELECT x FROM other)", "SELECT * FROM parquet.`/etc/x`", "WITH data AS (SELECT * FROM other) SELECT * FROM data", "SELECT 'with x as (' FROM x", "SELECT ( FROM data"):
        with pytest.raises(guard.Refused):
            guard.check(spark, sql, {"data"})
    spark.createDataFrame([(1, 2.0)], "col_1 int, revenue double").createOrReplaceTempView("data")
    assert guard.run(spark, "SELECT revenu FROM data", {"data"}).first()[0] == 2.0
    assert guard.number(spark.sql("SELECT sum(revenue) FROM data")) == 2.0 and guard.scalar(spark.sql("SELECT 1 WHERE false")) is None


@pytest.fixture
def views(spark):
    for name in ("mine", "secret", "other"):
        spark.createDataFrame([(1, name)], "id int, v string").createOrReplaceTempView(name)


@pytest.mark.parametrize(
    "sql",
    [
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT * FROM secret WHERE id IN (WITH secret AS (SELECT 1 AS id) SELECT id FROM secret)",
        "WITH `parquet./root/x` AS (SELECT 1 AS x) SELECT * FROM parquet.`/root/x`",
        "WITH RECURSIVE secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a",
        "WITH a AS (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) SELECT * FROM secret",
        "SELECT * FROM (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) x, secret",
        "SELECT * FROM mine UNION ALL (WITH a AS (SELECT * FROM secret) SELECT * FROM a)",
        "SELECT (SELECT max(id) FROM secret) FROM mine",
        "SELECT * FROM mine WHERE EXISTS (SELECT 1 FROM secret WHERE secret.id = mine.id)",
        "SELECT * FROM mine, LATERAL (SELECT * FROM secret WHERE secret.id = mine.id)",
        "SELECT * FROM mine ORDER BY (SELECT max(id) FROM secret)",
        "SELECT * FROM default.mine",
        "SELECT * FROM IDENTIFIER('sec' || 'ret')",
        "SELECT * FROM secret TIMESTAMP AS OF '2024-01-01'",
        "SELECT TRANSFORM(v) USING 'cat' AS (v) FROM mine",
        "SELECT reflect('java.lang.System', 'getenv', 'PATH') FROM mine",
        "SELECT id FROM mine WHERE java_method('java.util.UUID', 'randomUUID') IS NOT NULL",
        "SELECT * FROM sql_keywords()",
        "SELECT * FROM csv.`/etc/passwd`",
        "WITH t.x AS (SELECT 1) SELECT * FROM t.x",
        "EXPLAIN EXTENDED SELECT * FROM secret",
        "WITH a AS (SELECT 1 AS x) FROM a INSERT INTO mine SELECT *",
    ],
)
def test_guard_scopes_refused(spark, views, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql, {"mine"})


@pytest.mark.parametrize(
    ("sql", "n"),
    [
        ("WITH a AS (SELECT * FROM mine), b AS (SELECT * FROM a) SELECT * FROM b JOIN a USING (id)", 1),
        ("WITH secret AS (SELECT * FROM mine) SELECT * FROM secret", 1),
        ("WITH a AS (WITH b AS (SELECT * FROM mine) SELECT * FROM b) SELECT * FROM a", 1),
        ("WITH a AS (SELECT * FROM mine) SELECT * FROM (WITH a AS (SELECT 2 AS id) SELECT * FROM a)", 1),
        ("WITH a AS (SELECT * FROM mine) SELECT * FROM mine WHERE id IN (SELECT id FROM a)", 1),
        ("WITH mine AS (SELECT * FROM mine) SELECT * FROM mine", 1),
        ("WITH A AS (SELECT * FROM MINE) SELECT count(*) FROM a HAVING count(*) > 0", 1),
        ("WITH RECURSIVE n AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM n WHERE x < 3) SELECT * FROM n", 3),
        ("SELECT m.id, x FROM mine m LATERAL VIEW explode(array(1, 2)) AS x", 2),
        ("SELECT * FROM mine, LATERAL (SELECT mine.id + 1 AS y)", 1),
        ("SELECT * FROM mine PIVOT (count(v) FOR id IN (1, 2))", 1),
        ("SELECT row_number() OVER w FROM mine WINDOW w AS (PARTITION BY id ORDER BY v)", 1),
        ("SELECT DISTINCT id FROM mine UNION SELECT 2 EXCEPT SELECT 5 ORDER BY 1 LIMIT 5 OFFSET 0", 2),
        ("SELECT * FROM range(3) r JOIN VALUES (1), (2) v(id) USING (id)", 2),
        ("SELECT id, sum(id) FROM mine GROUP BY ROLLUP (id)", 2),
        ("SELECT /*+ BROADCAST(mine) */ * FROM mine TABLESAMPLE (100 PERCENT)", 1),
        ("SELECT * FROM mine UNPIVOT (value FOR name IN (id))", 1),
        ("SELECT * FROM (SELECT * FROM `mine`) AS x(a, b)", 1),
    ],
)
def test_guard_scopes_accepted(spark, views, sql, n):
    if "/*" in sql:  # hints look like comments, which are refused before
        with pytest.raises(guard.Refused):
            guard.check(spark, sql, {"mine"})
        sql = sql.replace("/*+ BROADCAST(mine) */ ", "")
    assert guard.run(spark, sql, {"mine"}).count() == n


def test_guard_names(spark, views):
    assert guard.relations(spark, "WITH a AS (SELECT * FROM X.y) SELECT * FROM a, z, `q.r`") == {("x", "y"), ("z",), ("q.r",)}
    assert guard.check(spark, "SELECT * FROM guarded_db.t1", {"guarded_db.t1"})
    with pytest.raises(guard.Refused):
        guard.check(spark, "SELECT * FROM `guarded_db.t1`", {"guarded_db.t1"})
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(guard.Refused):
            guard.check(spark, "WITH SECRET AS (SELECT 1 AS id) SELECT * FROM secret", {"mine"})
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    spark.createDataFrame([(1,)], "vvx int").createOrReplaceTempView("mine")
    assert guard.run(spark, "SELECT vv FROM mine", {"mine"}).columns == ["vvx"]


def test_names_paths_code(tmp_path):
    assert cleaning.client_of("MyCompany123") == "mycompany123" and guard.client("MyCompany123") == "mycompany123"
    assert cleaning.client_of("") == cleaning.client_of("../../../etc") == "invalid"
    assert cleaning.tenant_of("Test Client:123") == "test_client_123" and cleaning.tenant_of(None) == "default_client"
    for p in ("../../etc/passwd", "/some/path/../../../etc/passwd", "~/.ssh/id_rsa", "", "a\x00b"):
        with pytest.raises(guard.Refused):
            guard.path(p)
    assert guard.path(str(tmp_path / "x"), [str(tmp_path)])
    with pytest.raises(guard.Refused):
        guard.path(f"{tmp_path}x", [str(tmp_path)])
    assert guard.python("def run(df): return df['revenue'].sum()")
    for code in ("os.system('rm -rf /')", "subprocess.call(['ls'])", "eval('dangerous')", "__import__('os').system('ls')", "open('/etc/passwd', 'w')", "import os", "().__class__", "def run(:"):
        with pytest.raises(guard.Refused):
            guard.python(code)
    assert cleaning.json_names(["a b", "A-b", "2x", "é!"]) == ["a_b", "A_b_1", "col_2", "é"]
    assert cleaning.sheet_names(["Net (%)", "net %", ""]) == ["net", "net_1", "unnamed"]
    assert cleaning.sql_names(["Net Sales", "net.sales", "7"]) == ["net_sales", "net_sales_1", "col_7"]
    assert ids.parsed("c:doc_1_a:s:t") == {"client_id": "c", "doc_id": "doc_1_a", "sheet_name": "s:t"}
    assert ids.dataset_id("My Co", "Doc 1", "A-b") == "my_co:doc_1:a_b" and ids.short_id("query").startswith("qry_")
    assert ids.valid_user("a-b_1") and not ids.valid_user("") and not ids.valid_id("a b")


def test_types(spark):
    df = spark.createDataFrame([(f"0{i:03d}", f"EUR {i}.50", f"2024-01-{1 + i % 28:02d}", f"({i})", "a" if i % 2 else "b", f"word {i}") for i in range(40)], "`a.b` string, price string, day string, neg string, cat string, t string")
    out, kinds = cleaning.inferred(df)
    assert kinds == {"a.b": "id", "price": "number", "day": "date", "neg": "id", "cat": "category", "t": "text"}
    assert out.first()["price"] == 0.5 and str(out.first()["day"]) == "2024-01-01 00:00:00"
    assert cleaning.cleaned(df).columns == ["a_b", "price", "day", "neg", "cat", "t"]
    some = spark.createDataFrame([("1", "x", None), (None, None, None), ("n/a", "y", None)], "a string, `B c` string, d string")
    got = cleaning.from_sheet(some)
    assert got.columns == ["a", "b_c"] and got.count() == 2 and dict(got.dtypes)["a"] == "double"
    assert cleaning.coerced(spark.createDataFrame([("1",), ("x",)], "a string")).dtypes == [("a", "string")]


def test_audit(spark):
    inv = spark.createDataFrame([("1", 100.0, 1), ("2", 100.0, 2), ("3", 100.0, 3), ("4", 100.0, 4), (None, 5.0, 5), ("6", None, 6)], "id string, amount double, row_idx int")
    po = spark.createDataFrame([("1", 100.0, 1), ("1", 5.0, 2), ("2", 50.0, 3), ("3", 50.0, 4)], "id string, amount double, row_idx int")
    ledger = spark.createDataFrame([("1", 100.5, 1), ("2", 100.0, 2), ("3", 9.0, 3)], "id string, amount double, row_idx int")
    got = audit.three_way_match(inv, po, ledger)
    assert {r.id: r.status for r in got.collect()} == {"1": "matched", "2": "invoice_po_mismatch", "3": "three_way_mismatch", "4": "unmatched_po"}
    plain = audit.three_way_match(inv, po, ledger, unmatched=False)
    assert audit.match_verdict(plain).first().match_rate == 50.0 and audit.match_verdict(plain).first().verdict == "fail"
    assert [(r.id, r.difference) for r in audit.discrepancies(got).collect()] == [("2", 50.0), ("3", 50.0)]
    few = audit.benford_verdict(spark.range(5).withColumn("x", F.col("id") + 0.0), "x").first()
    assert few.n == 5 and few.verdict == "warning" and few.chi_square is None
    sides = spark.createDataFrame([("7", 1.0)], "Invoice_ID string, Total double")
    assert audit.side(sides, "invoice").first()[:2] == ("7", 1.0)


def test_histogram_and_quantiles(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    row = logs.histogram(df, "k", "v").first()
    assert tuple(row) == ("k", 100, 0.0, 99.0, 49.5, 50.0, 95.0, 99.0)
    rng = np.random.default_rng(1)
    x = np.exp(rng.standard_normal(3000) * 4).tolist() + [5.0] * 500
    frame = spark.createDataFrame([(v, None if i % 7 else v) for i, v in enumerate(x)], "a double, b double").repartition(3)
    got = profile.quantiles(frame, ["a", "b"], (0.0, 0.25, 0.5, 0.9, 1.0), 16)
    assert np.allclose(got["a"], np.quantile(x, [0, 0.25, 0.5, 0.9, 1]), rtol=1e-12)
    assert np.allclose(got["b"], np.quantile(x[::7], [0, 0.25, 0.5, 0.9, 1]), rtol=1e-12)
    assert profile.quantiles(frame.limit(0), ["a"], (0.5,)) == {}


def test_profile_report(spark, sheet):
    rep = profile.report(sheet, "row_idx")
    assert "COLUMN SCHEMA" in rep and "DATA QUALITY" in rep and "CORRELATION" in rep and "SAMPLE DATA" in rep
    kinds = profile.classified(spark.createDataFrame([("2024", 1, 0.5, 10.0, "x", 7.0)], "fy string, cust_id long, share double, revenue double, region string, other double"))
    assert kinds == {"fy": "temporal", "cust_id": "identifier", "share": "ratio", "revenue": "financial_metric", "region": "dimension", "other": "metric"}
    assert profile.report(sheet.limit(0)) == "DataFrame is empty (0 rows × 0 columns)"
    assert profile.hints(sheet, 10) == [] and profile.hints(sheet.withColumnRenamed("FY2023", "Sales"), 10)[0].startswith("Layout")


def test_hashes(spark):
    df = spark.createDataFrame([(1, "abcde"), (2, "ab"), (3, ""), (4, None)], "doc_id long, text string")
    sets = {r.doc_id: r.s for r in df.select("doc_id", text.shingles(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    assert sets == {1: ["abc", "bcd", "cde"], 2: ["ab"], 3: [], 4: []}
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest"
    near = spark.createDataFrame([(1, base), (2, base.replace("lazy", "idle")), (3, "unrelated words about ledgers, audits, taxes and quarterly results of banks"), (4, "")], "doc_id long, text string")
    prints = {r.doc_id: r.simhash for r in text.fingerprints(near).collect()}
    bits = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count()
    assert bits(1, 2) < 20 < bits(1, 3) + 10 and bits(1, 2) < bits(1, 3) and prints[4] == 0
    signed = text.minhash(near, "doc_id").withColumnRenamed("signature", "a")
    pair = signed.where("doc_id = 1").select("a").crossJoin(signed.where("doc_id = 2").select(F.col("a").alias("b")))
    assert pair.select(text.signature_similarity(F.col("a"), F.col("a")), text.signature_similarity(F.col("a"), F.col("b"))).first()[0] == 1.0
    ham = spark.createDataFrame([(0b1010, 0b1001)], "a long, b long").select(text.hamming(F.col("a"), F.col("b"))).first()[0]
    assert ham == 2


def test_bm25(spark):
    docs = spark.createDataFrame([(i, f"Revenue profit quarter {i}") for i in range(20)], "doc_id long, text string")
    got = text.bm25(docs, "quarter 7", 3).collect()
    assert got[0].doc_id == 7 and text.bm25(docs, "nothing").count() == 0 and text.bm25(docs.limit(0), "x").count() == 0
    assert text.bm25(docs, "").count() == 0


def test_retrieval(spark):
    vectors = spark.createDataFrame([(1, [0.5, 0.5, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in text.cosine(vectors, [1.0, 0.0, 0.0]).collect()]
    assert got[0] == (2, 1.0) and abs(got[1][1] - 0.70710678) < 1e-8 and got[2] == (3, 0.0)
    chunks = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "")], "chunk_id string, text string")
    known = spark.createDataFrame([("a", [9.0]), ("q", [1.0])], "chunk_id string, vector array<double>")
    out = {r.chunk_id: r.vector for r in text.missing_embeddings(chunks, known).collect()}
    assert set(out) == {"a", "b", "c"} and out["a"] == [9.0] and abs(sum(x * x for x in out["b"]) - 1) < 1e-12 and set(out["c"]) == {0.0}
    calls = []

    def search(n):
        calls.append(n)
        return spark.createDataFrame([(i, 0.6 if i < 2 else 0.1) for i in range(min(n, 8))], "doc_id long, score double")

    assert text.widened(search, 5).count() == 2 and calls == [15, 30]
    cand = spark.createDataFrame([("t", None, None), ("u", "v", 0.5)], "text string, content string, score double")
    assert [(r.content, r.score) for r in text.normalised(cand).collect()] == [("t", 0.0), ("v", 0.5)]
    assert spark.range(1).select(text.squashed(F.lit(5.0))).first()[0] == 0.75
    items = spark.createDataFrame([("g", i, i, s) for i, s in enumerate([30, 90, 50, 40, 20])] + [("h", 0, 9, 500)], "group string, rank long, id long, size long")
    for at_once in (1, 2, 1000):
        packed = {r.group: (r.ids, r.used) for r in text.packed_to_budget(items, 100, at_once).collect()}
        assert packed == {"g": ([0, 2, 4], 100), "h": ([], 0)}


def test_context(spark):
    found = spark.createDataFrame([(1, "a" * 30, 0.2), (2, "b" * 20, 0.9), (3, "c" * 18, 0.5)], "doc_id long, text string, score double")
    row = text.context(found, 10, "|").first()
    assert row.context == "b" * 20 + "|" + "c" * 18 and row.used == 38 and text.context(found.limit(0)).count() == 0


def test_chunks(spark):
    rows = ["h | i"] + [f"{'x' * 90} | {i}" for i in range(12)]
    docs = spark.createDataFrame([(1, "\n".join(rows)), (2, "\n\n".join(["p" * 300] * 4)), (3, "short"), (4, None)], "doc_id long, text string")
    got = {}
    for r in text.document_chunks(docs).orderBy("doc_id", "chunk").collect():
        got.setdefault((r.doc_id, r.kind), []).append(r.text)
    assert len(got[1, "table"]) > 1 and all(t.startswith("h | i\n") for t in got[1, "table"])
    assert [len(t) for t in got[2, "prose"]] == [300, 351, 351, 351] and (3, "prose") not in got


def test_formats():
    assert formats.markdown([["Header1", "Header2"], ["A", "B"], ["C", "D"]]) == "| Header1 | Header2 |\n| --- | --- |\n| A | B |\n| C | D |"
    assert formats.rupees_of(25000000) == "₹2.50 crores" and formats.rupees_of(-250000) == "negative ₹2.50 lakhs" and formats.rupees_of(0) == "₹0"
    assert formats.sentence("how many rows", 0).startswith("There are no") and formats.sentence("is there any mention of bonds?", None) == "No, there are no mentions of bonds in this data."
    assert formats.sentence("what is the total", "1,500") == "The value is ₹1,500.00." and formats.sentence("growth", -3) == "There was a decline of 3.00%."
    assert formats.tidy("Answer: it is so") == "it is so." and formats.is_empty("₹0") and not formats.is_empty("x")
    long = "\n".join(["# Head", *["filler words here and there" for _ in range(60)], "Total: 42", "end"])
    short = formats.summary(long, 40)
    assert "Total: 42" in short and "# Head" in short and "summarized from" in short and formats.summary("x", 40) == "x"
    assert formats.truncated("a. " * 400, 50).endswith("...[truncated]") and len(formats.smart_chunks("\n\n".join(["w" * 400] * 6), 250)) == 3


def test_repair():
    assert repair.tolerant_json('```json\n{"a": 1,}\n```') == {"a": 1}
    assert repair.tolerant_json("{'a': True, b: None}") == {"a": True, "b": None}
    assert repair.tolerant_json('so: {"x": {"y": 2}} ok')["x"] == {"y": 2}
    assert repair.tolerant_json("name: Bob, n: 3")["n"] == 3 and repair.tolerant_json("")["fallback"] and repair.tolerant_json("[1, 2]") == {"result": [1, 2]}
    assert repair.sql('SELECT "1", col.3 FROM t WHERE "label" = 1', ["a", "b c"]) == "SELECT `b c`, col_3 FROM t WHERE `a` = 1"
    assert repair.sql("SELECT {col 2}, b c FROM my_t", ["a", "b c"], "my__t") == "SELECT `col_2`, `b c` FROM my__t"
    assert repair.sql_in("Sure:\n```sql\nSELECT a FROM t;\n```") == "SELECT a FROM t" and repair.sql_in("no") is None
    assert repair.sql_in("Use SELECT a, b FROM t WHERE x = 1; then") == "SELECT a, b FROM t WHERE x = 1"
    assert repair.python_in("x\n```python\ndef run(df):\n    return 1\n```").startswith("def run") and repair.python_in("x") is None


def test_charts(spark):
    chart = {"type": "BAR", "title": "T", "data": [{"x": "a", "y": "1.5"}, {"x": "b", "y": "2"}]}
    told, found = charts.extracted("Here.\n```json\n" + json.dumps({"charts": [chart, {"type": "none"}]}) + "\n```\nBye")
    assert told == "Here.\n\nBye" and len(found) == 1 and found[0]["type"] == "bar" and found[0]["data"][0]["y"] == 1.5
    row = spark.createDataFrame([("x",)], "a string").select(charts.charts_in("a").alias("c")).first().c
    assert row.text == "x" and row.n == 0


def test_templates(spark):
    df = spark.createDataFrame([("Revenue", 10.0, 20.0, 25.0, 30.0), ("Tax", 1.0, 2.0, 3.0, 4.0)], "item_name string, fy21 double, fy22 double, actual double, budget double")
    ask = lambda q: templates.answered(df, q)
    assert ask("what is the total fy21")[0].first()[0] == 11.0 and ask("average of fy22")[0].first()[0] == 11.0
    assert ask("how many rows are there")[0].first()[0] == 2 and ask("growth of revenue from fy21 to fy22")[0].first()[0] == 10.0
    assert ask("what was revenue in fy22")[0].first()[0] == 20.0 and ask("variance of revenue actual vs budget")[0].first()["variance_pct"] == -16.67
    assert ask("sing a song") is None and templates.lenient(df, "sum", "21").first()[0] == 11.0 and templates.lenient(df, "sum", "zz") is None
    assert templates.matching_column("9M FY22".replace(" ", ""), ["FY22", "9MFY22"]) == "9MFY22"


def test_tools(spark, sheet):
    frames = {"s": sheet, "n": spark.range(1, 400).select((F.col("id") * 1.7).alias("Amount"))}
    reg = tools.Registry(frames.__getitem__)
    got = reg.execute("benford_test", dataset="n", column="amount")
    assert got.status == "success" and got.verdict == "fail" and reg.execute("nope").status == "error" and reg.execute("benford_test", dataset="?", column="x").status == "error"
    assert reg.intended("what is the cohort retention") == "cohort_analysis" and reg.respond("hello")["success"] is False
    assert reg.respond("check fraud", dataset="n", column="Amount")["tool_used"] == "benford_test" and len(reg.history) == 3
    assert tools.run_code(sheet, "def run(df):\n    return df.agg({'FY2024': 'sum'}).first()[0]") == 34615000 + 5000
    by = tools.run_code_by_group(sheet, "import pandas as pd\ndef run(pdf):\n    return pd.DataFrame({'n': [len(pdf)]})", "n long", "particulars")
    assert by.count() == 10
    with pytest.raises(guard.Refused):
        tools.run_code(sheet, "import os\ndef run(df): return 1")
    tools.register_functions(spark)
    assert spark.sql("SELECT mean_of_middle(id) FROM range(100)").first()[0] == 49.5
    assert spark.sql("SELECT similarity('sales', 'net sales')").first()[0] == 0.95
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    assert tools.retried(call, sleep=lambda s: None) == 7
    assert tools.plain({"a": np.float64(1.5), "b": pd.Series([1, 2])}) == {"a": 1.5, "b": [1, 2]}


def test_logs(spark):
    rows = [Row(log_id="1", timestamp_utc="2024-01-01T00:00:00Z", query_text="q", result="r", provenance="p", status="success", method=None, latency_ms=None), Row(log_id="2", timestamp_utc="2024-01-01T00:00:00Z", query_text=None, result=None, provenance=None, status="error", method=None, latency_ms=5.0), Row(log_id="3", timestamp_utc="2024-01-30T00:00:00Z", query_text=None, result=None, provenance=None, status=None, method=None, latency_ms=None)]
    df = spark.createDataFrame(rows, "log_id string, timestamp_utc string, query_text string, result string, provenance string, status string, method string, latency_ms double")
    assert {r.log_id: r.tier for r in logs.tier(df).collect()} == {"1": "high_value", "2": "medium_value", "3": "low_value"}
    assert [r.log_id for r in logs.purged(df, F.lit("2024-02-10").cast("timestamp")).collect()] == ["1"]
    assert logs.archive(df).first().asDict()["user_query"] == "q"
    masked = logs.masked(spark.createDataFrame([("a", "b" * 600, 1)], "Full_Name string, note string, n int")).first()
    assert masked.Full_Name == "<MASKED>" and masked.note.endswith("...<truncated>") and masked.n == 1
