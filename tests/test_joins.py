"""As-of, interval and overlap joins against brute force, over groups that are cut into ranges, gaps wider than a range, nulls,
repeated rows and ties; none by a nested loop."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import joins
from ledgerspark.operators.joins import asof_join, interval_join, overlap_join


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def sides(seed, n=400, groups=6, span=1000):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.04 else x
    group = lambda: maybe(0 if rng.random() < 0.4 else rng.randrange(groups))
    # right keys only in a few places: wide gaps
    left = [(i, group(), maybe(rng.randrange(span))) for i in range(n)]
    right = [(group(), maybe(rng.choice([3, 4, 5, 400, 410, 990]) + rng.randrange(3)), rng.randrange(5), f"r{i}") for i in range(60)]
    return left + left[:20], right + right[:5]


def expected(left, right, direction, strict=False, within=None, grouped=True):
    out = []
    for i, g, k in left:
        fit = [] if k is None or (grouped and g is None) else [r for r in right if r[1] is not None and (not grouped or r[0] == g)]
        back = [r for r in fit if (r[1] < k if strict else r[1] <= k) and (within is None or k - r[1] <= within)]
        on = [r for r in fit if (r[1] > k if strict else r[1] >= k) and (within is None or r[1] - k <= within)]
        b = max(back, key=lambda r: (r[1], r[2], r[3]), default=None)
        f = max(on, key=lambda r: (-r[1], r[2], r[3]), default=None)
        best = b if direction == "backward" else f if direction == "forward" else f if f and (not b or f[1] - k < k - b[1]) else b
        out.append((i, g, k, best[3] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize(("strict", "ranges"), [(False, 8), (True, 256)])
def test_asof(spark, monkeypatch, direction, strict, ranges):
    monkeypatch.setattr(joins, "RANGES", ranges)  # 8: the sample holds less than all rows, so large groups are cut
    left, right = sides(len(direction))
    l, r = spark.createDataFrame(left, "id int, g int, k int").repartition(3), spark.createDataFrame(right, "g int, rk int, o int, name string")
    by = asof_join(l, r, ("k", "rk"), ["g"], ["name"], direction, strict=strict, order=["o", "name"])
    assert got(by) == expected(left, right, direction, strict)
    near = asof_join(l, r, ("k", "rk"), ["g"], ["name"], direction, F.lit(50), strict, order=["o", "name"])
    assert got(near) == expected(left, right, direction, strict, 50)
    alone = asof_join(l, r.drop("g"), ("k", "rk"), (), ["name"], direction, strict=strict, order=["o", "name"])
    assert got(alone) == expected(left, right, direction, strict, grouped=False)
    inner = asof_join(l, r, ("k", "rk"), ["g"], ["name"], direction, strict=strict, order=["o", "name"], how="inner") if strict else by.where("name is not null")
    assert got(inner) == [x for x in expected(left, right, direction, strict) if x[3] is not None]
    for df in (by, alone):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_asof_gap_over_many_ranges(spark, monkeypatch):
    """One right row, and one group cut into many ranges: it's carried through all of them."""
    monkeypatch.setattr(joins, "RANGES", 8)
    l = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    r = spark.createDataFrame([("g", 7, "only")], "g string, rk long, name string")
    assert len(joins._cuts(l.select(F.col("g").alias("__g0"), F.col("k").alias("__key")), ["__g0"])[("g",)]) == 7
    out = asof_join(l, r, ("k", "rk"), ["g"], ["name"])
    assert out.where("name = 'only'").count() == 4993 and out.count() == 5000
    assert asof_join(l, r, ("k", "rk"), ["g"], ["name"], "forward").where("name = 'only'").count() == 8
    assert asof_join(l, r, ("k", "rk"), (), ["name"]).where("name = 'only'").count() == 4993


def test_asof_kinds(spark):
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)
    l = spark.createDataFrame([(1, day(5)), (2, day(0)), (3, None)], "id int, t timestamp_ntz")
    r = spark.createDataFrame([(day(1), "a"), (day(4), "b")], "t2 timestamp_ntz, name string")
    assert got(asof_join(l, r, ("t", "t2"), take=["name"])) == sorted([(1, day(5), "b"), (2, day(0), None), (3, None, None)], key=str)
    assert got(asof_join(l, r, ("t", "t2"), take=["name"], within=F.expr("interval 30 minutes"))) == sorted([(1, day(5), None), (2, day(0), None), (3, None, None)], key=str)
    x = spark.createDataFrame([(1, float("nan")), (2, 1.5), (3, -0.0)], "id int, `a.b` double")
    y = spark.createDataFrame([(0.0, "z"), (1.0, "one"), (float("nan"), "n")], "y double, name string")
    assert [r[2] for r in got(asof_join(x, y, ("a.b", "y"), take=["name"]))] == ["n", "one", "z"]
    none = spark.createDataFrame([], "t2 timestamp_ntz, name string")
    assert {r.name for r in asof_join(l, none, ("t", "t2"), take=["name"]).collect()} == {None} and asof_join(l.limit(0), r, ("t", "t2"), take=["name"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(l, r.withColumnRenamed("name", "id"), ("t", "t2"))
    with pytest.raises(ValueError):
        asof_join(l, r, ("t", "t2"), direction="sideways")


def spans(seed, n):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.04 else x
    out = []
    for i in range(n):
        a = rng.choice([rng.uniform(-50, 50), rng.randrange(-50, 50), 0.0])
        out.append((maybe(rng.randrange(3)), maybe(float(a)), maybe(float(a + rng.choice([0, 1e-9, 0.25, 1, 2, 3, 7, 300, -1]))), f"s{i}"))
    return out


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
def test_interval(spark, closed):
    rng = random.Random(closed)
    intervals = spans(3, 80)
    ends = [x for s in intervals for x in s[1:3] if x is not None]
    points = [(i, rng.choice([0, 1, 2, None]), rng.choice([None, float("nan"), float(rng.randrange(-60, 60)), *rng.sample(ends, 3)])) for i in range(150)]
    l, r = spark.createDataFrame(points, "id int, g int, x double").repartition(3), spark.createDataFrame(intervals, "g int, a double, b double, name string")
    inside = lambda x, a, b: (a <= x if closed in ("left", "both") else a < x) and (x <= b if closed in ("right", "both") else x < b)
    for how in ("inner", "left"):
        for by in (["g"], []):
            want = []
            for i, g, x in points:
                fit = [s for s in intervals if x is not None and None not in s[1:3] and s[1] <= s[2] and (not by or (g is not None and g == s[0])) and inside(x, s[1], s[2])]
                want += [(i, g, x, *((s[1], s[2], s[3]) if by else s[1:])) for s in fit] if fit else [(i, g, x, None, None, None)] * (how == "left")
            df = interval_join(l, r if by else r.drop("g"), "x", "a", "b", by, closed, how)
            assert list(map(str, got(df))) == sorted(map(str, want))  # as text, for NaN
            assert "NestedLoop" not in df._jdf.queryExecution().toString()


def test_interval_kinds(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    l = spark.createDataFrame([(1, t(3)), (2, t(9))], "id int, t timestamp_ntz")
    r = spark.createDataFrame([(t(1), t(4), "a"), (t(3), t(3), "point"), (t(0), datetime.datetime(2124, 1, 1), "long")], "a timestamp_ntz, b timestamp_ntz, name string")
    assert sorted((x.id, x.name) for x in interval_join(l, r, "t", "a", "b", closed="both").collect()) == [(1, "a"), (1, "long"), (1, "point"), (2, "long")]
    huge = spark.createDataFrame([(1, 2.0**60), (2, 2.0**60 + 4096)], "id int, x double")
    wide = spark.createDataFrame([(2.0**60 - 10000, 2.0**60 + 300, "w"), (-(2.0**70), 2.0**70, "all"), (2.0**60, float("inf"), "up")], "a double, b double, name string")
    assert sorted((x.id, x.name) for x in interval_join(huge, wide, "x", "a", "b").collect()) == [(1, "all"), (1, "up"), (1, "w"), (2, "all"), (2, "up")]
    assert interval_join(l, r.limit(0), "t", "a", "b").count() == 0 and interval_join(l, r.limit(0), "t", "a", "b", how="left").count() == 2
    with pytest.raises(ValueError):
        interval_join(l, r.withColumnRenamed("name", "id"), "t", "a", "b")


def test_overlap(spark):
    one, two = spans(5, 60), spans(6, 60)
    l, r = spark.createDataFrame(one, "g int, a double, b double, p string"), spark.createDataFrame(two, "g int, c double, d double, q string")
    whole = lambda s: None not in s[:3] and s[1] < s[2]
    want = [(*x, *y[1:]) for x in one for y in two if whole(x) and whole(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    assert got(overlap_join(l, r, ("a", "b"), ("c", "d"), ["g"])) == sorted(want, key=str)


@pytest.mark.parametrize("few", [joins.FEW, 50])
def test_many_intervals_are_not_broadcast(spark, monkeypatch, few):
    """However small a file looks: only so many intervals as were counted go to all tasks."""
    monkeypatch.setattr(joins, "FEW", few)
    rng = random.Random(5)
    points = [(i, rng.randrange(4) if i % 9 else None, rng.randrange(500)) for i in range(300)]
    spans = [(rng.randrange(4), lo, lo + rng.randrange(1, 90)) for lo in (rng.randrange(500) for _ in range(60))]
    left, right = spark.createDataFrame(points, "i int, g int, p int"), spark.createDataFrame(spans, "g int, lo int, hi int")
    df = interval_join(left, right, "p", "lo", "hi", ["g"], how="left")
    want = []
    for i, g, p in points:
        of = [(i, g, p, lo, hi) for h, lo, hi in spans if h == g and lo <= p < hi]
        want += of or [(i, g, p, None, None)]
    assert got(df) == sorted(want, key=str)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and ("BroadcastHashJoin" in plan) == (few > 2 * len(spans))
