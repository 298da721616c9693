"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, hot groups, and
other columns with names that operators use themselves."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import decontamination, grouped_ranking, hilbert_search, mtree_search, negative_mining

LINE = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, pos string, part string, node string, h string"
COLUMNS = ["sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "flag", "shipped_at"]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def sale_lines(seed, n=600):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.05 else x
    out = []
    for _ in range(n):
        hot = rng.random() < 0.34
        day = datetime.datetime(2024, rng.randint(1, 5), rng.randint(1, 28))
        out.append((maybe(rng.randint(0, 200)), maybe(rng.randint(1, 4)), maybe(rng.randint(0, 12)), maybe(7 if hot else rng.randint(0, 9)), maybe(rng.choice([1, 5, 9, 10, 25, 49])), maybe(rng.choice([2.45, 0.005, 10.1, float("nan"), -3.0])), maybe(rng.choice([0.0, 0.05, 0.1])), "kept", maybe(day)))
    return out + out[:40]


def ranked(spark, data, parts):
    return grouped_ranking.ranked_lines(spark.createDataFrame([(*r, "p", "q", "r", "s") for r in data], LINE).repartition(parts))


@pytest.mark.parametrize("k", [1, 2, 7])
def test_ranking(spark, k):
    data = sale_lines(k)
    lines = spark.createDataFrame([(*r, "p", "q", "r", "s") for r in data], LINE).repartition(5)
    want = grouped_ranking.brute_force([dict(zip(COLUMNS, r, strict=True)) for r in data], k)
    assert got(grouped_ranking.ranked_lines(lines, k)) == sorted(want, key=str)


def test_ranking_runs_and_nodes(spark, monkeypatch):
    """Many short runs, a hot group in all of them, and nodes over nodes."""
    monkeypatch.setattr(grouped_ranking, "RUN", 64)
    monkeypatch.setattr(grouped_ranking, "LEAST_HOT", 4)
    monkeypatch.setattr(grouped_ranking, "FAN", 3)
    data = sale_lines(11, 2000)
    want = grouped_ranking.brute_force([dict(zip(COLUMNS, r, strict=True)) for r in data])
    assert got(ranked(spark, data, 30)) == sorted(want, key=str)


def test_ranking_one_pair(spark):
    """All rows of one group tie; only their order tells them apart."""
    day = datetime.datetime(2024, 2, 1)
    data = [(1, i % 9, 5, 3, 11, 1.0, 0.05, "x", day) for i in range(400)]
    want = grouped_ranking.brute_force([dict(zip(COLUMNS, r, strict=True)) for r in data])
    out = got(ranked(spark, data, 7))
    assert out == sorted(want, key=str) and {r[-1] for r in out} == {400}


def test_ranking_empty_and_large(spark):
    assert got(ranked(spark, [], 2)) == []
    big = spark.createDataFrame([(2**63 - 1, -(2**63), None), (2**63 - 1, 2**63 - 1, -1), (None, 0, 0), (-(2**63), 1, 1)], "g long, t long, o long")
    out = got(grouped_ranking.leaders(big, ["g"], [("t", True)], ["o"], 1))
    assert out == sorted([(2**63 - 1, 2**63 - 1, -1, 1, 1), (None, 0, 0, 1, 1), (-(2**63), 1, 1, 1, 1)], key=str)


DOC = "doc_id long, text string, lang string, key string, words string, w string, n_hit string"
ITEM = "item_id long, text string, win string, h string"


def docs_and_items(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "éa", "ß1", "the"]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, some(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(12)] + [(3, "w1 w2"), (50, None), (51, ""), (52, "..."), (None, some(12)), (53, "THE the The the"), (54, " ".join(["the"] * 15))]
    items += [(60 + i, items[6][1]) for i in range(5)]
    docs = []
    for i in range(60):
        t = some(rng.randint(0, 60))
        if i % 3 == 0:
            t = f"{t}, {rng.choice(items)[1] or ''}. {some(rng.randint(0, 5))}"
        docs.append((i, t.upper() if i % 5 == 0 else t))
    docs += [(100, None), (101, ""), (102, "-- ::"), (103, "the " * 300), (None, items[1][1]), (None, None), (7, docs[7][1]), (7, "other w1 w2"), (104, "x" * 5000 + " " + items[2][1]), (105, items[3][1])]
    return docs, items


def test_decontamination(spark):
    for seed in (1, 2):
        docs, items = docs_and_items(seed)
        d = spark.createDataFrame([(*r, "en", "k", "x", "y", "z") for r in docs], DOC).repartition(3)
        b = spark.createDataFrame([(*r, "x", "y") for r in items], ITEM).repartition(2)
        assert got(decontamination.decontaminated(d, b)) == sorted(decontamination.brute_force(docs, items), key=str)


def test_decontamination_hot(spark, monkeypatch):
    """One item in a third of the documents, and in itself many times."""
    monkeypatch.setattr(decontamination, "HOT", 4)
    passage = " ".join(f"p{i}" for i in range(25))
    items = [(i, passage if i % 2 else f"{passage} q{i}") for i in range(20)]
    docs = [(i, f"a b {passage} c {passage}" if i % 3 else "a b c") for i in range(90)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontamination.decontaminated(d, b)) == sorted(decontamination.brute_force(docs, items), key=str)


def test_decontamination_empty(spark):
    d, b = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert got(decontamination.decontaminated(d, b)) == []
    assert got(decontamination.decontaminated(d, some.select(F.lit(1).alias("item_id"), "text"))) == []
    assert got(decontamination.decontaminated(some, b)) == sorted(decontamination.brute_force([(1, "a b")], []), key=str)


def test_decontamination_plan(spark):
    """Native: no Python in the plan."""
    docs, items = docs_and_items(3)
    plan = decontamination.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


VECTOR = "vec_id long, embedding array<float>, label int, cell string, far string, shard string, anchor_id string"


def embeddings(seed, n, d=8, clusters=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    out = []
    for i in range(n):
        v = (centres[rng.integers(clusters)] + rng.normal(size=d) * 0.3).astype(np.float32)
        out.append((i, [float(x) for x in v], int(rng.integers(labels))))
    out += [(n + i, out[5][1], 1) for i in range(30)] + [(10 * n, [0.0] * d, 2)]
    return out


def vectors(spark, data):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in data], VECTOR).repartition(3)


def test_negatives(spark, monkeypatch):
    data = embeddings(1, 700)
    assert got(negative_mining.mined(vectors(spark, data))) == sorted(negative_mining.brute_force(data), key=str)
    monkeypatch.setattr(negative_mining, "SHARD", 50)  # several cells and shards, a small sample and small leaves
    monkeypatch.setattr(negative_mining, "SAMPLE", 40)
    monkeypatch.setattr(negative_mining, "LEAF", 8)
    assert got(negative_mining.mined(vectors(spark, data))) == sorted(negative_mining.brute_force(data), key=str)


def test_negatives_odd(spark):
    data = embeddings(2, 300)
    bad = [(None, data[0][1], 1), (9001, None, 1), (9002, [1.0, None] + [0.0] * 6, 1), (9003, [float("nan")] * 8, 1), (9004, [float("inf")] * 8, 1), (9005, data[0][1], None), (9006, [1.0], 1), (9007, [], 1), (3, None, 3), (5, [float("nan")] * 8, 3)]
    repeated = [*data, data[100], data[0], *bad]
    assert got(negative_mining.mined(vectors(spark, repeated))) == sorted(negative_mining.brute_force(data), key=str)
    assert got(negative_mining.mined(vectors(spark, []))) == []
    assert got(negative_mining.mined(vectors(spark, data[:1]))) == []


def test_negatives_large(spark):
    """Scores beyond 2 ** 53 are exact; those beyond a long are refused."""
    data = [(i, [x * 1e6 for x in v], label) for i, v, label in embeddings(3, 300)]
    wide = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert got(negative_mining.mined(wide)) == sorted(negative_mining.brute_force(data), key=str)
    with pytest.raises(ArithmeticError):
        negative_mining.mined(spark.createDataFrame([(i, [x * 1e150 for x in v], label) for i, v, label in data[:20]], "vec_id long, embedding array<double>, label int"))


def plain_vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>")


def test_top_k_large(spark):
    """Scores beyond 2 ** 53 are exact integers; those beyond a long are refused."""
    rng = np.random.default_rng(7)
    data = [(i, [float(v) for v in rng.normal(size=16) * 3e6]) for i in range(300)]
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in data}
    out = {}
    for r in mtree_search.top_k(plain_vectors(spark, data)).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 300, 20):
        scores = sorted(((-sum(x * y for x, y in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q))[:20]
        assert sorted(out[q]) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
        assert max(-s for s, _ in scores) > 2**53
    with pytest.raises(ArithmeticError):
        mtree_search.top_k(plain_vectors(spark, [(i, [x * 1e148 for x in v]) for i, v in data[:20]]))


@pytest.mark.parametrize("factor", [1.0, 1e6, 1e155, 1e-170])
def test_nearest_large(spark, factor):
    """Whatever the size of the components, the same neighbours; scores beyond doubles are infinite."""
    rng = np.random.default_rng(8)
    data = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(200)]
    many = lambda f: [(r.query_id, r["rank"], r.vec_id, r.score) for r in hilbert_search.nearest(plain_vectors(spark, [(i, [x * f for x in v]) for i, v in data]), share=1.0).orderBy("query_id", "rank").collect()]
    same, other = many(1.0), many(factor)
    assert len(other) == 200 and [x[:2] for x in same] == [x[:2] for x in other]
    assert np.mean([x[2] == y[2] for x, y in zip(same, other, strict=True)]) > 0.99  # components are rounded anew
    with np.errstate(over="ignore", under="ignore"):
        assert np.allclose([x[3] for x in other], np.array([x[3] for x in same]) * factor * factor, rtol=1e-9, atol=0) or factor == 1e-170


def test_nearest_mixed_sizes(spark):
    """A short query beside very long rows has its neighbours too."""
    rng = np.random.default_rng(9)
    data = [(i, [float(v) for v in rng.normal(size=6) * (1e-160 if i % 40 == 0 else 1e160)]) for i in range(120)]
    out = hilbert_search.nearest(plain_vectors(spark, data), share=1.0).collect()
    assert {r.query_id for r in out} == {0, 20, 40, 60, 80, 100} and len(out) == 120
    v = dict(data)
    want = sorted((i for i in v if i != 40), key=lambda i: (-float(np.dot(np.array(v[40]) * 1e160, np.array(v[i]) / 1e160)), i))[:20]
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 40] == want
