"""Catalogs on disk, files of every kind, JSON of every shape, and real streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerspark.session import session
from ledgerspark.sources import catalog, json_tables, pages, sheets
from ledgerspark.streaming import events, state


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "c"))
    assert c.all().count() == 0
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    key = c.register("My Co:doc_1_ab:Sheet 1", df, meta={"file": "f.csv"})
    assert key == "my_co:doc_1_ab:sheet 1" and c.register("doc_1_ab:other", df, "My Co") == "my_co:doc_1_ab:other"
    c.register("solo", df, "else")
    assert c.load("My Co:doc_1_ab:Sheet 1", "my co").count() == 2 and c.load("My Co:doc_1_ab:Sheet 1", "else") is None
    assert [r.dataset_id for r in c.datasets("My Co").select("dataset_id").collect()] == [key, "my_co:doc_1_ab:other"]
    assert c.datasets("My Co").first().doc == "doc_1_ab" and c.datasets("My Co").first().dtypes == {"a": "int", "b": "string"}
    assert c.rehydrated("My Co", [key, "my_co:doc_9:x"]) == ([key], ["my_co:doc_9:x"]) and spark.table("my_co_doc_1_ab_sheet_1").count() == 2
    assert c.related(key, "My Co").count() == 2 and "2 sheets" in c.sheets("My Co") and c.metrics().count() == 2
    assert not c.delete(key, "else") and c.delete(key, "My Co") and not c.exists(key, "My Co")
    again = catalog.Catalog(spark, str(tmp_path / "c"))
    assert again.all().count() == 2 and again.exists("solo", "else")
    wanted = spark.createDataFrame([("else:misc:solo",), (key,), ("x:y:z",), (None,)], "dataset_id string")
    assert [r[0] for r in again.known(wanted).collect()] == [r.dataset_id for r in again.datasets("else").collect()]
    # from itself, and a write that fails
    solo = again.load("solo", "else")
    again.register("solo", solo.unionByName(solo.withColumn("a", F.col("a") + 10)), "else")
    assert again.load("solo", "else").count() == 4 and again.datasets("else").count() == 1 and solo.count() == 2
    with pytest.raises(Exception, match="(?i)divi|raise"):
        again.register("solo", again.load("solo", "else").withColumn("a", F.raise_error(F.lit("division")).cast("int")), "else")
    assert again.load("solo", "else").count() == 4
    for bad in ("../etc:doc:x", "a/b:doc:x"):
        with pytest.raises(ValueError):
            c.at(bad)
    with pytest.raises(ValueError):
        c.register("x", spark.createDataFrame([()], ""), "me")


def test_ids(spark, tmp_path):
    i = catalog.Ids(spark, str(tmp_path / "ids"))
    a, was = i.create("u1")
    assert not was and i.create("u1") == (a, True) and i.create("u1", "n2")[0] != a
    assert i.of("u1").count() == 2 and i.reason("u1", a) == "valid" and i.reason("u2", a).startswith("ID belongs") and i.reason("u1", "q") == "ID not found"
    with pytest.raises(ValueError):
        i.create("a b")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Value\nA,100\nB,200\nC,300\n")
    df = catalog.read(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Name", "Value"] and catalog.read(spark, str(tmp_path / "a.csv"), typed=True).agg(F.sum("Value")).first()[0] == 600
    catalog.view(spark, "My View", str(tmp_path / "a.csv"))
    assert spark.sql("SELECT sum(value) FROM my_view").first()[0] == 600
    assert catalog.scanned(spark, str(tmp_path / "a.csv"), "SELECT count(*) FROM {table}").first()[0] == 3
    assert "- Name (string): A, B, C" in catalog.described(df)
    with pytest.raises(catalog.Unsupported):
        catalog.read(spark, "x.zip")
    assert catalog.s3_settings(endpoint="http://h", session_token="t")["fs.s3a.path.style.access"] == "true" and catalog.s3_settings() == {}
    import pandas as pd

    found = sheets.from_frames(spark, {"one": pd.DataFrame({"A b": ["1", "n/a", "3"], "Unnamed: 1": [None, None, None]}), "two": pd.DataFrame({"x": [1.0, 2.0], "y": ["p", "q"]}), "tiny": pd.DataFrame({"x": [1]})})
    assert list(found) == ["one", "two"] and found["one"].dtypes == [("a_b", "double")] and sheets.best(found)[0] in found
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("page one\fpage two " + "w " * 200)
    (tmp_path / "d" / "y.txt").write_text("page one\fpage two " + "w " * 200)
    read = pages.read(spark, str(tmp_path / "d"))
    fresh = pages.new_only(read, spark.createDataFrame([("none",)], "doc_hash string"))
    assert read.count() == 4 and fresh.count() == 2 and pages.new_only(read, read.select("doc_hash")).count() == 0
    pages.written(pages.chunked(fresh), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


SHAPES = {
    "records": [{"a b": 1, "c": {"d": 2}}, {"a b": 3, "c": None}],
    "columnar": {"x": [1, 2], "y": ["p", "q"]},
    "nested_tables": {"t1": [{"a": "1"}, {"a": "2"}], "t2": [5, 6, 7], "n": 1},
    "single_record": {"a": 1, "b": "x"},
    "complex_nested": {"top": 1, "l1": {"l2": {"l3": {"l4": {"v": 1}}, "rows": [{"k": 1, "tags": ["x", "y"], "in": {"z": 2}}]}}},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_json(spark, tmp_path, shape):
    (tmp_path / "j.json").write_bytes(json.dumps(SHAPES[shape]).encode())
    got, tables = json_tables.tables(json_tables.read(spark, str(tmp_path / "j.json")), "My-File X")
    assert got == shape
    rows = {k: [r.asDict() for r in v.collect()] for k, v in tables.items()}
    want = {
        "records": {"my_file_x": [{"a_b": 1, "c": '{"d":2}'}, {"a_b": 3, "c": None}]},
        "columnar": {"my_file_x": [{"x": 1, "y": "p"}, {"x": 2, "y": "q"}]},
        "nested_tables": {"my_file_x:t1": [{"a": 1.0}, {"a": 2.0}], "my_file_x:t2": [{"t2": 5}, {"t2": 6}, {"t2": 7}]},
        "single_record": {"my_file_x": [{"a": 1, "b": "x"}]},
    }
    if shape in want:
        assert rows == want[shape]
    else:
        assert rows["my_file_x:l1_l2_rows"] == [{"in_z": 2, "k": 1, "tags": "x, y"}] and rows["my_file_x:overview"] == [{"l1_l2_l3_l4_v": 1, "top": 1}]


def test_json_unknown(spark):
    assert json_tables.structure(ArrayType(LongType())) == "unknown" and json_tables.structure(StructType()) == "unknown"
    assert json_tables.structure(StructType([StructField("a", StringType())])) == "single_record"
    with pytest.raises(ValueError):
        json_tables.tables(json_tables.parsed(spark, "[1, 2]"), "x")


def streamed(spark, tmp_path, df, op, mode):
    """What op gives on df as a stream, file by file, as a list of rows."""
    for i, part in enumerate(df):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if i + 1 < len(df) else 0)
    out = []
    stream = spark.readStream.schema(df[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = op(stream).writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend((i, r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_stream_windows_and_sessions(spark, tmp_path):
    at = lambda *rows: spark.createDataFrame(list(rows), "user_id int, event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    first = at((1, "a", 1.0, "2024-01-01 00:10:00"), (1, "a", 2.0, "2024-01-01 00:50:00"), (1, "a", 4.0, "2024-01-01 05:00:00"))
    more, late = at((1, "a", 16.0, "2024-01-01 09:00:00")), at((1, "a", 8.0, "2024-01-01 00:20:00"), (1, "a", 1.0, "2024-01-01 12:00:00"))
    got = {str(r.window_start): r.n for _, r in streamed(spark, tmp_path, [first, more, late], events.counts_by_window, "append")}
    assert got["2024-01-01 00:00:00"] == 2 and got["2024-01-01 05:00:00"] == 1
    (tmp_path / "s").mkdir()
    found = [(r.user_id, r.n) for _, r in streamed(spark, tmp_path / "s", [first, more], events.sessions, "append")]
    assert (1, 1) in found and len(found) >= 2


def test_stream_budget_jobs_once(spark, tmp_path):
    stamp = lambda df: df.withColumn("at", F.col("at").cast("timestamp"))
    one = stamp(spark.createDataFrame([("c", "2024-01-01 00:00:00", 8.0), ("c", "2024-01-01 00:00:01", 5.0)], "client string, at string, tokens double"))
    two = stamp(spark.createDataFrame([("c", "2024-01-01 00:00:04", 5.0), ("d", "2024-01-01 00:00:04", 11.0)], "client string, at string, tokens double"))
    batch = {(r.client, r.tokens, str(r.at)): r.allowed for r in state.budgeted(one.union(two), 1.0, 10.0).collect()}
    (tmp_path / "a").mkdir()
    stream = {(r.client, r.tokens, str(r.at)): r.allowed for _, r in streamed(spark, tmp_path / "a", [one, two], lambda s: state.budgeted(s, 1.0, 10.0), "append")}
    assert batch == stream and sorted(batch.values()) == [False, False, True, True]
    j1 = stamp(spark.createDataFrame([("t", "pending", "2024-01-01 00:00:00", None), ("t", "running", "2024-01-01 00:00:01", None)], "task_id string, status string, at string, error string"))
    j2 = stamp(spark.createDataFrame([("t", "error", "2024-01-01 00:00:05", "no"), ("t", "running", "2024-01-01 00:00:06", None)], "task_id string, status string, at string, error string"))
    (tmp_path / "b").mkdir()
    out = streamed(spark, tmp_path / "b", [j1, j2], state.jobs, "update")
    assert [r.status for _, r in out] == ["running", "error"] and out[-1][1].error == "no" and out[-1][1].finished_at - out[-1][1].started_at == 5
    assert state.jobs(j1.union(j2)).first().status == "error"
    r1 = stamp(spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:01"), ("m", "2024-01-01 00:00:01")], "key string, at string"))
    (tmp_path / "c").mkdir()
    assert len(streamed(spark, tmp_path / "c", [r1], lambda s: state.once(s, "key"), "append")) == 2 and state.once(r1, "key").count() == 2


def test_stream_within(spark, tmp_path):
    """The stream's counts equal the batch's, whatever the order of arrival within the watermark; late rows aside."""
    rng = random.Random(3)
    at = lambda s: f"2024-01-01 00:{s // 60 % 60:02d}:{s % 60:02d}"
    made = [(f"c{rng.randrange(3)}", i, i // 3 + rng.randrange(5)) for i in range(240)]
    frame = lambda rows: spark.createDataFrame([(c, i, at(s)) for c, i, s in rows], "client string, request_id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    files = [frame(made[a : a + 60]) for a in range(0, 240, 60)] + [frame([("c0", 1000, 3000), (None, 1001, 3000)]), frame([("c0", 1002, 3500)])]
    want = {(r.client, r.request_id): r.n for r in state.within(frame(made)).collect()}
    got = {(r.client, r.request_id): r.n for _, r in streamed(spark, tmp_path, files, lambda s: state.within(s), "append")}
    assert {k: v for k, v in got.items() if int(k[1]) < 1000} == want and len(want) == 240
    assert got[("c0", "1000")] == 1 and max(want.values()) > 20


def test_batched(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([10, 200, 900, None]), rng.choice([1, 2, None]), f"2024-01-01 {rng.randrange(5):02d}:{rng.randrange(60):02d}:00") for i in range(300)]
    df = spark.createDataFrame(rows, "request_id int, tokens int, priority int, at string").withColumn("at", F.col("at").cast("timestamp"))
    by = {}
    for i, t, p, a in rows:
        by.setdefault("short" if t == 10 else "medium" if t == 200 else "long", []).append(((p is not None, p or 0), a, i))
    want = {i: (b, n // 8) for b, found in by.items() for n, (_, _, i) in enumerate(sorted(found))}
    assert {r.request_id: (r.bucket, r.batch) for r in state.batched(df).collect()} == want


def test_arriving_and_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n3,4\n")
    seen = []
    run = lambda: state.arriving(spark, str(tmp_path / "in"), "x int, y int", lambda df: seen.append(df.count()), str(tmp_path / "cp"))
    assert run() == 2 and run() == 0
    (tmp_path / "in" / "b.csv").write_text("x,y\n5,6\n")
    assert run() == 1 and sum(seen) == 3
    told = list(state.events(spark.range(5), 2))
    assert [t["event"] for t in told] == ["start", "rows", "rows", "rows", "done"] and told[-1]["count"] == 5


def test_session(spark):
    assert session(partitions=4).conf.get("spark.sql.session.timeZone") == "UTC"
