"""What Python workers hold at once doesn't grow with their Arrow batches: the functions that run in them are called here."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from ledgerspark import batches
from ledgerspark.functions import formats
from ledgerspark.operators import retrieval, text
from ledgerspark.plans import queries as core
from ledgerspark.sources import json_documents


def grabbed(monkeypatch, made):
    """The function that made() gives to mapInArrow."""
    got = []
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", lambda self, run, schema: got.append(run) or self)
        made()
    return got[-1]


def peak(run, batch):
    """Rows that come out, and MB of Python and numpy objects at most."""
    tracemalloc.start()
    rows = sum(len(b) for b in run([batch]))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, most


def corpus(n=3000, words=300):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(5000)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([" ".join(rng.sample(vocabulary, words)) for _ in range(n)])], ["doc_id", "text"])


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "a b")], "doc_id long, text string")


def test_parts_keep_all_rows(monkeypatch):
    monkeypatch.setattr(batches, "PART", 10)
    monkeypatch.setattr(batches, "ITEMS", 3)
    of = lambda *texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "t"])
    got = [b.column(1).to_pylist() for b in batches.parts([of("abc", None, "", "defghij", "x" * 40, "k"), of("yy")])]
    assert got == [["abc", None, "", "defghij"], ["x" * 40], ["k"], ["yy"]]
    got = [b.column(1).to_pylist() for b in batches.parts([of(["a", "b"], [], None, ["c", "d"], list("abcde"))])]
    assert got == [[["a", "b"], [], None], [["c", "d"]], [list("abcde")]]


def test_fingerprints_hold_a_part(monkeypatch, docs):
    rows, most = peak(grabbed(monkeypatch, lambda: text.fingerprints(docs)), corpus())
    assert rows == 3000 and most < 30


def test_fingerprints_forget_and_vote_in_parts(spark, monkeypatch):
    """Same fingerprints whatever is remembered, and however few words vote at once."""
    rows = [(i, t) for i, t in enumerate(corpus(60, 40).column(1).to_pylist())] + [(60, ""), (61, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, text.fingerprints(frame).collect()))
    monkeypatch.setattr(text, "WORDS_KEPT", 5)
    monkeypatch.setattr(text, "VOTING", 7)
    assert sorted(map(tuple, text.fingerprints(frame).collect())) == want and len(want) == 62


def test_minhash_holds_a_part(monkeypatch, docs):
    run = grabbed(monkeypatch, lambda: text.minhash(docs, "doc_id", 2))
    made = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([[f"{(i + j) % 5000:03d}" for j in range(500)] for i in range(3000)])], ["doc_id", "s"])
    rows, most = peak(run, made)
    assert rows == 3000 and most < 30


def test_sketcher_forgets(monkeypatch):
    """More shingles than are remembered, within a set and over sets, change no value."""
    sets = [[f"{i}" for i in range(a, a + n)] for a, n in ((0, 10), (5, 40), (3, 1), (30, 0), (100, 23))]
    sketch = text.Sketcher(4)
    want = [sketch(s) for s in sets]
    monkeypatch.setattr(text, "MEMORY", 8)
    small = text.Sketcher(4)
    assert [small(s) for s in sets] == want and len(small.values) == 16 and want[3] == [0] * 4


def test_postings_hold_a_part(monkeypatch, docs):
    rows, most = peak(grabbed(monkeypatch, lambda: retrieval.counted(docs)), corpus())
    assert rows == 3000 * 301 and most < 30


def test_summaries_hold_a_part(spark, monkeypatch):
    """Many texts in one batch, in parts, as one by one."""
    texts = [None, "", "one line", *("\n".join(f"# line {j} of {i}, total 5" for j in range(900)) for i in range(300))]
    tracemalloc.start()
    got = formats.summary_udf.func(pa.array(texts)).to_pylist
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert got() == [None if t is None else formats.summary(t) for t in texts] and most < 4
    assert len(formats.summary_udf.func(pa.array([], pa.string()))) == 0


def test_json_shapes_by_row(spark, tmp_path):
    """Shapes without a shuffle; documents of one id stay apart, and an id may be null."""
    texts = [("1", '{"k": 1}'), ("1", '{"k": 1, "items": [{"sku": 5, "qty": 2}]}'), (None, '{"items": [{"sku": 6, "qty": 1}]}'), ("2", '{"a": {"b": {"c": {"d": 1}}}}'), ("3", '{"a": {"b": {"c": {}}}}'), ("4", "{}"), ("5", "[1]"), ("6", '[{"a": 1}]'), ("7", '{"a": [1], "b": [2]}'), ("8", "{bad"), ("9", None)]
    shaped = json_documents.shapes(json_documents.parsed(spark.createDataFrame(texts, "id string, text string")))
    got = sorted((str(r.id), r["shape"]) for r in shaped.select("id", "shape").collect())
    assert got == sorted([("1", "single_record"), ("1", "nested_tables"), ("None", "nested_tables"), ("2", "complex_nested"), ("3", "single_record"), ("4", "unknown"), ("5", "unknown"), ("6", "records"), ("7", "columnar"), ("8", "unknown"), ("9", "unknown")])
    assert "Exchange" not in shaped._jdf.queryExecution().toString()
    spark.createDataFrame([(None if i is None else int(i), t) for i, t in texts[:3]], "click_id long, props string").write.parquet(f"{tmp_path}/clicks.parquet")
    items = core.QUERIES["json_click_items"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, items))) == ["(1, 5, 2)", "(None, 6, 1)"]
