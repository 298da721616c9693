"""What is kept and read again: indexes, filters, sketches, tables by version; workbooks and JSON documents."""

import datetime
import json
import math
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import membership, retrieval, sketches, text
from ledgerspark.sources import catalog, json_documents, json_tables, sheets, versioned, workbook

FILES = {
    "records": [{"a b": 1, "c": {"d": 2}}, {"a b": 3, "c": None}],
    "columnar": {"x": [1, 2], "y": ["p", "q"]},
    "nested_tables": {"t1": [{"a": "1"}, {"a": "2"}], "t2": [5, 6, 7], "n": 1},
    "single_record": {"a": 1, "b": "x"},
    "complex_nested": {"top": 1, "l1": {"l2": {"l3": {"l4": {"v": 1}}, "rows": [{"k": 1, "tags": ["x", "y"], "in": {"z": 2}}]}}},
    "unknown": [1, 2],
}


def plain_bm25(docs, question, k):
    words = {i: t.lower().split() for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    held = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in held.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for i, ws in words.items():
        f = Counter(ws)
        out[i] = round(sum(m * (idf[w] if idf[w] >= 0 else floor) * f[w] * 2.5 / (f[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w, m in Counter(question.lower().split()).items() if w in f), 8)
    return sorted(((i, s) for i, s in out.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]


def about(rows):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]


def test_index(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["the", "The", *(f"w{i}" for i in range(40))]
    docs = [(i, " ".join(rng.choice(vocabulary) if rng.random() < 0.7 else "the" for _ in range(rng.randint(1, 40)))) for i in range(80)] + [(900, ""), (901, "  \t\n"), (902, "the w1 é")]
    path = str(tmp_path / "index")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert retrieval.state(spark, path) is None
    one = retrieval.add(path, frame.where("doc_id % 2 = 0"))
    two = retrieval.add(path, frame)  # those that are there already stay as they are
    assert two.docs == 83 and two.version == one.version + 1 and len(two.batches) == 2
    questions = ["the w1 w2 w1", "w3", "é", "nothing here", ""]
    for q in questions:
        assert about(retrieval.search(spark, path, q, 7).collect()) == about(plain_bm25(docs, q, 7))
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")
    every = retrieval.search_all(path, asked, 7).collect()
    for i, q in enumerate(questions):
        assert sorted(about((r["rank"], r.doc_id, r.score) for r in every if r.question_id == i)) == about((n, *x) for n, x in enumerate(plain_bm25(docs, q, 7), 1))
    # only the terms' buckets are read
    plan = retrieval.search(spark, path, "w3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    # what a failed addition leaves isn't read
    with pytest.raises(ValueError):
        retrieval.add(path, spark.createDataFrame([(1000, "w3"), (1000, "w4")], "doc_id long, text string"))
    with pytest.raises(ValueError):
        retrieval.add(path, spark.createDataFrame([(None, "w3")], "doc_id long, text string"))
    assert retrieval.state(spark, path) == two and about(retrieval.search(spark, path, "w3", 7).collect()) == about(plain_bm25(docs, "w3", 7))
    with pytest.raises(ValueError):
        retrieval.search(spark, str(tmp_path / "none"), "x")


def test_fingerprints(spark):
    import hashlib

    def plain(t):
        votes = [0] * 64
        for w in t.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest(), 16)
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        v = sum(1 << b for b in range(64) if votes[b] > 0)
        return v - (1 << 64) if v >> 63 else v

    texts = ["a b c", "", "A  a b\x1cc", "é ü 中文 x", "w " * 500 + "z", None]
    got = {r.doc_id: r.simhash for r in text.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}


def test_membership(spark, tmp_path):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    m = membership.Membership(spark, str(tmp_path / "m"), keys=3000)
    assert m.asked(keys, "k").where("perhaps").count() == 0
    m.add(keys.where("length(k) < 4"), "k")
    m.add(keys.where("length(k) >= 4").union(spark.createDataFrame([(None,)], "k string")), "k")
    again = membership.Membership(spark, str(tmp_path / "m"), keys=5)  # the folder's own size counts
    assert again.words == m.words and again.asked(keys, "k").where("not perhaps").count() == 0
    others = spark.range(20000).select(F.concat(F.lit("z"), "id").alias("k"))
    assert again.among(others, "k").count() < 600 and again.asked(spark.createDataFrame([(None,)], "k string"), "k").first().perhaps is False
    before = again.stats().first()
    again.compacted()
    assert again.stats().first() == before and len(again.states.latest().parts) == 1 and 0.2 < before.fill < 0.6
    # parts merge to what all keys give at once
    whole = {r.word: r.bits for r in membership.bits_of(keys, "k", m.words).collect()}
    assert {r.word: r.bits for r in again.bits().collect()} == whole
    left = spark.createDataFrame([(i, f"k{i}") for i in range(0, 6000, 7)] + [(-1, None)], "i int, k string")
    assert membership.semi_join(left, keys.withColumnRenamed("k", "o"), "k", "o").count() == len(range(0, 3000, 7))


def test_sketches(spark):
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i % 200)
    rows = spark.createDataFrame([(day(i), f"u{i % 700}", float(i % 1000) if i % 50 else None, "ab"[i % 2]) for i in range(6000)] + [(None, "u1", float("nan"), "a")], "t timestamp_ntz, u string, x double, g string")
    days = sketches.by_day(rows, "t", ["g"], ["u"], ["x"])
    assert days.count() == 9 * 2 + 1
    whole = sketches.merged(days, ["g"]).select("g", "n", sketches.distinct_of("u").alias("u"), sketches.quantile_of("x", 0.5).alias("half"))
    exact = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("u").alias("u"))
    for r, e in zip(whole.orderBy("g").collect(), exact.orderBy("g").collect(), strict=True):
        assert r.n == e.n and abs(r.u - e.u) <= max(1, sketches.DISTINCT_ERROR * e.u) and abs(r.half - 500) <= 2 * sketches.RANK_ERROR * 1000
    # merged in one step or in two
    for days_or_groups in (days, sketches.merged(days, ["g"])):
        assert abs(sketches.merged(days_or_groups).select(sketches.distinct_of("u")).first()[0] - 700) <= sketches.DISTINCT_ERROR * 700
    late = sketches.by_day(rows.where("t < '2024-01-02'").limit(3), "t", ["g"], ["u"], ["x"])
    kept = sketches.replaced(days, late)
    assert kept.where("day = '2024-01-01'").agg(F.sum("n")).first()[0] == 3 and kept.where("day <> '2024-01-01'").count() == days.where("day <> '2024-01-01'").count()
    assert kept.where("day is null").count() == 1


def test_table(spark, tmp_path):
    t = versioned.Table(spark, str(tmp_path / "t"), "k", "v", 8)
    assert t.rows() is None and t.delete(spark.createDataFrame([(1,)], "k int")) == []
    rows = lambda x: spark.createDataFrame(x, "k int, v int, `a.b` string")
    t.upsert(rows([(i, 1, "first") for i in range(100)] + [(5, 2, "newer"), (None, 1, "none")]))
    parts = dict(t.states.latest().parts)
    assert len(parts) == 8 and t.rows().count() == 101 and t.rows().where("k = 5").first()["a.b"] == "newer"
    touched = t.upsert(rows([(7, 1, "equal"), (8, 0, "old"), (200, 1, "new")] + [(9, i, "hot") for i in range(50)]))
    now = dict(t.states.latest().parts)
    assert 1 <= len(touched) <= 4 and {b for b in now if now[b] != parts[b]} == set(touched)
    got = {r.k: (r.v, r["a.b"]) for r in t.rows().collect()}
    assert got[7] == (1, "equal") and got[8] == (1, "first") and got[200] == (1, "new") and got[9] == (49, "hot") and len(got) == 102
    # from itself; a write that fails
    t.overwrite(t.rows().withColumn("v", F.col("v") + 1))
    assert t.rows().where("k = 7").first().v == 2 and t.rows().count() == 102
    old = t.rows()
    with pytest.raises(Exception, match="(?i)raise|stop"):
        t.upsert(rows([(1, 9, "x")]).withColumn("a.b", F.raise_error(F.lit("stop"))))
    assert t.rows().count() == 102 and t.rows().where("k = 1").first().v == 2
    assert t.delete(spark.createDataFrame([(1,), (77,)], "k int")) and t.rows().count() == 100 and old.count() == 102
    assert t.vacuum() >= 2 and t.rows().count() == 100 and t.vacuum() == 0
    t.overwrite(rows([]))
    assert t.rows().count() == 0 and t.upsert(rows([(1, 1, "a")])) and t.rows().count() == 1


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def written_book(path, sheets_xml, names, strings=(), styles="", old=False):
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS}>{"<workbookPr date1904=\"1\"/>" if old else ""}<sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{kind}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(1, len(names) + 1))
        links += f'<Relationship Id="a" Type="{kind}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="b" Type="{kind}/styles" Target="/xl/styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(strings)}</sst>")
        z.writestr("xl/styles.xml", styles or f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        for i, xml in enumerate(sheets_xml, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{xml}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    strings = ["<si><t>Name</t></si>", "<si><r><t>Net </t></r><r><t>Sales</t></r><rPh sb='0' eb='1'><t>read aloud</t></rPh></si>", "<si><t>A &amp; B</t></si>"]
    first = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>Day</t></is></c><c r="E2" t="str"><v>Flag</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1.5</v></c><c r="C3" s="1"><v>45292</v></c><c r="E3" t="b"><v>1</v></c></row>'
        '<row r="4"/><row r="5"><c r="A5" t="inlineStr"><is><t>C</t></is></c><c r="B5" s="3"><v>-20</v></c><c r="C5" s="2"><v>45292.75</v></c><c r="D5"/><c r="E5" t="e"><v>#N/A</v></c></row>'
    )
    second = "".join(f"<row>{''.join(f'<c><v>{i * j}</v></c>' for j in range(1, 4))}</row>" for i in range(1, 40))
    written_book(tmp_path / "b.xlsx", [first, second, "", '<row r="1"><c r="A1"><v>1</v></c></row>'], ["One &amp; only", "Numbers", "Empty", "Tiny"], strings)
    cells = workbook.rows(spark, str(tmp_path / "b.xlsx"))
    assert [(r.sheet, r.name, r.n) for r in cells.groupBy("sheet", "name").agg(F.count("*").alias("n")).orderBy("sheet").collect()] == [(0, "One & only", 3), (1, "Numbers", 39), (3, "Tiny", 1)]
    got = {r.row: [c and (c.kind, c.value) for c in r.cells] for r in cells.where("sheet = 0").collect()}
    assert got[2] == [("text", "Name"), ("text", "Net Sales"), ("text", "Day"), None, ("text", "Flag")]
    assert got[3] == [("text", "A & B"), ("number", "1.5"), ("date", "2024-01-01"), None, ("bool", "true")]
    assert got[5][2] == ("date", "2024-01-01 18:00:00") and got[5][1] == ("number", "-20") and got[5][4] == ("error", "#N/A")
    frames = workbook.read(spark, str(tmp_path / "b.xlsx"))
    assert list(frames) == ["One & only", "Numbers"] and frames["One & only"].columns == ["name", "net_sales", "day", "flag"]
    assert frames["One & only"].agg(F.sum("net_sales")).first()[0] == -18.5 and frames["Numbers"].count() == 38
    assert sheets.best(frames)[0] in frames and catalog.read(spark, str(tmp_path / "b.xlsx")).columns
    # many workbooks at once, the older calendar, and what isn't one
    (tmp_path / "many").mkdir()
    for i in range(3):
        written_book(tmp_path / "many" / f"m{i}.xlsx", ['<row><c t="inlineStr"><is><t>d</t></is></c></row>' + '<row><c s="1"><v>0</v></c></row>' * 3], ["S"], old=i == 1)
    every = workbook.rows(spark, str(tmp_path / "many"))
    assert {r.v for r in every.where("row = 2").select(F.col("cells")[0]["value"].alias("v")).collect()} == {"1899-12-31", "1904-01-01"} and len(workbook.read(spark, str(tmp_path / "many"))) == 3
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="(?i)zip"):
        workbook.rows(spark, str(tmp_path / "bad.xlsx")).count()
    assert workbook.column_of("AA10") == 26 and workbook.column_of("Z1") == 25 and workbook.date_of(59, False) == "1900-02-28" and workbook.date_of(61, False) == "1900-03-01"


def test_json_documents(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / f"{name}.json").write_bytes(json.dumps(content).encode())
    (tmp_path / "latin.json").write_bytes('{"a": 7, "b": "é"}'.encode("latin-1"))
    (tmp_path / "broken.json").write_text('{"a": ')
    (tmp_path / "more.json").write_text(json.dumps([{"a b": 5, "c": {"d": 9, "e": "x"}}]))
    texts = json_documents.read(spark, str(tmp_path))
    name = F.regexp_extract("id", r"(\w+)\.json", 1)
    shaped = {r.n: r["shape"] for r in json_documents.shapes(json_documents.parsed(texts)).select(name.alias("n"), "shape").collect()}
    assert shaped == {**{k: k for k in FILES}, "latin": "single_record", "broken": "unknown", "more": "records"}
    # one by one, the same tables as from the driver's reader
    for kind in ("records", "columnar", "nested_tables", "single_record", "complex_nested"):
        found = json_documents.tables(texts.where(name == kind))
        want = json_tables.tables(json_tables.read(spark, str(tmp_path / f"{kind}.json")), "x")[1]
        assert {f"x:{k}" if k else "x" for k in found} == set(want)
        for k, df in found.items():
            other = want[f"x:{k}" if k else "x"]
            assert set(df.columns) - {"id"} == set(other.columns)
            columns = sorted(other.columns)
            assert sorted(map(str, df.select(columns).collect())) == sorted(map(str, other.select(columns).collect()))
    together = json_documents.tables(texts.where(name.isin("records", "more")))[""]
    assert sorted(map(tuple, together.select("a_b", "c").collect()), key=str) == [(1, '{"d":2}'), (3, None), (5, '{"d":9,"e":"x"}')]
    assert json_documents.tables(texts.where(name == "unknown")) == {} and json_documents.tables(texts.where("false")) == {}


def test_library(spark, tmp_path):
    from ledgerspark.sources.library import Library

    para = lambda w: "\n\n".join(f"{w} number {i} " + f"{w} and some more words of it. " * 6 for i in range(4))
    docs = spark.createDataFrame([("a", para("revenue")), ("b", para("inventory")), ("c", para("inventory")), ("d", None), ("e", ""), ("f", para("margin")), ("g", para("assets"))], "doc_id string, text string")
    mine = Library(spark, str(tmp_path), "My Co")
    assert mine.status() == {"client": "my_co", "documents": 0, "chunks": 0, "words": 0, "ready": False} and mine.asked("revenue").count() == 0
    one = mine.ingest(docs.where("doc_id = 'a'"))
    assert one["documents"] == 1 and one["chunks"] > 0
    two = mine.ingest(docs)  # b and c have one text
    assert two["documents"] == 3 and mine.ingest(docs) == {"documents": 0, "chunks": 0}
    told = Library(spark, str(tmp_path), "my co").status()
    assert told["ready"] and told["documents"] == 4 and told["chunks"] == one["chunks"] + two["chunks"] and told["words"] > 0
    found = mine.asked("inventory number", 3).collect()
    assert 0 < len(found) <= 3 and {r.doc_id for r in found} == {"b"} and all("inventory" in r.text for r in found)
    assert Library(spark, str(tmp_path), "other").status()["documents"] == 0
    with pytest.raises(ValueError):
        Library(spark, str(tmp_path), "../x")


def test_summary(spark):
    from ledgerspark.operators.summary import summarized

    rows = [("Revenue", 10.0, 12.0, 0), ("Net profit", 2.0, 3.5, 1), ("Cost of goods", 6.0, 0.0, 2)]
    told = summarized(spark.createDataFrame(rows, "particulars string, fy22 double, fy23 double, row_idx int"), "row_idx", 2, "total revenue in fy23")
    assert told["rows"] == 3 and ("Net profit", 3.5) in told["figures"] and ("Cost of goods", 6.0) in told["figures"]
    assert told["sample"][0]["particulars"] == "Revenue" and len(told["sample"]) == 2 and told["asked"][0] == "fy23" and set(told["columns"]) == {"particulars", "fy22", "fy23", "row_idx"}
    assert summarized(spark.createDataFrame([], "a int"))["rows"] == 0
