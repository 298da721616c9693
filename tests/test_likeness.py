"""Likeness over columns and as a join against the plain version, pair by pair; aggregates in two phases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import similarity as s
from ledgerspark.operators import aggregates

NAMES = [
    "Revenue", "net revenue", "Revenue from operations", "revenu", "reveneu growth", "Total_Sales", "sales.total", "EBITDA", "ebit", "pat", "Profit after tax",
    "profit-after-tax margin", "turnover", "growth", "YoY growth", "year on year growth", "cost of goods", "costs of good", "capital expenditure", "capex", "cash flow",
    "free cash flow to firm", "fcff", "enterprise value", "EV", "x", "ab", "a b", "", "   ", "__", "éclair", "ECLAIR", "inventory", "inventories", "Marketing spend", "ads spending", "digital marketing", "online ads", "%",
]


def mixed(seed, n=25):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(rng.choice([x for x in NAMES if len(x) > 3]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice("abcdefg _")
        out.append("".join(w))
    return out


def test_scored(spark):
    left, right = NAMES + mixed(1), NAMES + mixed(2)
    pairs = spark.createDataFrame([(a, b) for a in left for b in right] + [(None, "x"), ("x", None), (None, None)], "q string, t string")
    got = {(r.q, r.t): r.score for r in s.scored(pairs, "q", "t").collect()}
    for (a, b), score in got.items():
        assert score == pytest.approx(0.0 if a is None or b is None else s.similarity(a, b)), (a, b)
    # only a part is left to be compared by spelling
    left_open = pairs.where("q is not null and t is not null").distinct().where(s.undecided(s.plain_of(F.col("q")), s.plain_of(F.col("t")))).count()
    assert left_open < 0.35 * len(left) * len(right)


@pytest.mark.parametrize("least", [0.75, 0.85, 0.93])
def test_join(spark, least):
    left, right = NAMES + mixed(3), NAMES + mixed(4)
    want = {(a, b): s.similarity(a, b) for a in set(left) for b in set(right) if s.similarity(a, b) >= least}
    q = spark.createDataFrame([(x,) for x in [*left, None, "Revenue"]], "question string")
    t = spark.createDataFrame([(x,) for x in [*right, None]], "name string")
    got = {(r.question, r.name): r.score for r in s.likeness_join(q, t, least=least).collect()}
    want = {p: v for p, v in want.items() if s.plain(p[0]) and s.plain(p[1])}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        s.likeness_join(q, t, least=0.5)


def test_two_phases(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "HELD", 2)
    rng = np.random.default_rng(1)
    values = rng.gamma(2.0, size=4000)
    rows = [("hot" if i % 3 else "abcd"[i % 4], float(v) if i % 17 else None) for i, v in enumerate(values)] + [(None, 2.0), (None, 8.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.value for r in aggregates.aggregated(df, "g", "v", aggregates.KNOWN["kurtosis_of"]).collect()}
    want = {r.g: r.k for r in df.where("v is not null and not isnan(v)").groupBy("g").agg(F.kurtosis("v").alias("k")).collect()}
    assert set(got) == {"hot", *"abcd", None, "none", "nan"} and got["none"] is None and got["nan"] is None
    assert all(got[g] == pytest.approx(want[g]) for g in want)
    mean = {r.g: r.value for r in aggregates.aggregated(df, "g", "v", aggregates.KNOWN["geometric_mean"]).collect()}
    assert mean[None] == pytest.approx(4.0)
    aggregates.register(spark, "geometric_mean")
    df.createOrReplaceTempView("two_phases")
    sql = "SELECT * FROM geometric_mean(TABLE(SELECT * FROM geometric_mean_states(TABLE(two_phases))) PARTITION BY g)"
    assert {r.g: r.value for r in spark.sql(sql).collect()} == pytest.approx(mean)
    assert aggregates.aggregated(df.limit(0), "g", "v", aggregates.KNOWN["kurtosis_of"]).count() == 0
