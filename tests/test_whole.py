"""What SQL doesn't compare: small tables whose whole result is known."""

import hashlib
from itertools import combinations

import pytest

from ledgerspark.operators import text
from ledgerspark.plans import queries as core


@pytest.mark.parametrize("crowd", [1, 1000])
def test_close_fingerprints_links_all(spark, monkeypatch, crowd):
    """Every pair within 3 bits follows from the rows, equal fingerprints included."""
    monkeypatch.setattr(text, "CROWD", crowd, raising=False)
    texts = ["Net sales rose", "sales net ROSE!", "Net sales rose", "a quite different line", "Net sales rose", "one more"]
    prints = text.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    made = spark.createDataFrame([(10, 0b0), (11, 0b0), (12, 0b111), (13, 0b111), (14, 0b1111), (15, -1)], "doc_id long, simhash long")
    for given in (prints, made):
        of = {r.doc_id: r.simhash for r in given.collect()}
        want = {(a, b): n for a, b in combinations(sorted(of), 2) if (n := ((of[a] ^ of[b]) & (2**64 - 1)).bit_count()) <= 3}
        rows = text.close_fingerprints(given).collect()
        assert len({(r.a, r.b) for r in rows}) == len(rows) and all(r.a < r.b for r in rows)
        head = {x: x for x in of} | {r.b: r.a for r in rows if r.distance == 0}
        near = {(r.a, r.b): r.distance for r in rows if r.distance > 0}
        got = {(a, b): 0 if head[a] == head[b] else near.get(tuple(sorted((head[a], head[b])))) for a, b in combinations(sorted(of), 2)}
        assert {k: v for k, v in got.items() if v is not None} == want


def test_join_asof_nearest_keeps_far_and_unmatched(spark, tmp_path):
    spark.createDataFrame([(1, 5.5), (2, 10.0), (3, 300.9), (4, 25_000.2), (5, None), (6, 10.9), (7, -3.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(10,), (12,), (20_001,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.event_id: r.part for r in core.QUERIES["join_asof_nearest"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: 10, 3: 12, 4: 20_001, 5: None, 6: 10, 7: None}


def test_name_normalize_keeps_names_with_a_leading_digit(spark, tmp_path):
    spark.createDataFrame([(1, "Net Sales"), (2, "2023 Net"), (3, "#7 bolt")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.name for r in core.QUERIES["name_normalize"](spark, str(tmp_path)).collect()}
    assert got == {1: "net_sales", 2: "col_2023_net", 3: "col_7_bolt"}


def test_minhash_documents_has_128_values_and_empty_texts(spark, tmp_path):
    texts = ["", None, "ab", "abcd"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    value = lambda i, s: int.from_bytes(hashlib.sha256(i.to_bytes(4, "little") + s.encode()).digest()[:4], "little")
    grams = {0: [], 1: [], 2: ["ab"], 3: ["abc", "bcd"]}
    got = {r.doc_id: list(r.signature) for r in core.QUERIES["minhash_documents"](spark, str(tmp_path)).collect()}
    assert got == {d: [min((value(i, s) for s in g), default=0) for i in range(128)] for d, g in grams.items()}


def test_shingles_documents_has_empty_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(["", None, "ab", "abcabc"])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n for r in core.QUERIES["shingles_documents"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 3}
