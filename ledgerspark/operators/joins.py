"""Joins on order instead of equality: as-of joins and interval joins, as equi-joins that shuffle on groups and ranges.

`asof_join` puts both sides in one order by group and key. Groups that hold much of a bounded sample are cut into ranges of
keys; a window runs over each range alone, and what the ranges before it end with is carried on to the rows that found
nothing in theirs. `interval_join` gives intervals of about one length the bins of that length, two at most, and looks each
point up in its bin of each length that occurs. `overlap_join` is made of two of them. None of them compares all rows with
all rows, and none needs a side to be small. Hot keys of the equi-joins are left to adaptive execution, which splits them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A group with a RANGES-th of the rows is large; so many ranges at most, each cut from EACH rows of the sample.
RANGES, EACH = 256, 32
#: So many intervals, in all their bins, are sent to all tasks; more are shuffled, however small files make them look.
FEW = 1000


def _named(names: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    return [(n, n) if isinstance(n, str) else n for n in names]


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _cuts(rows: DataFrame, groups: list[str]) -> dict[tuple, list]:
    """By group, keys that cut it into ranges of about a RANGES-th of all rows, from a sample of RANGES * EACH rows. They
    decide where rows are worked on, never what comes out."""
    sample = rows.select(*groups, "__key", F.rand(0).alias("__r")).orderBy("__r").limit(RANGES * EACH).collect()
    keys: dict[tuple, list] = {}
    for r in sample:
        keys.setdefault(tuple(r[g] for g in groups), []).append(r["__key"])
    out = {}
    for group, found in keys.items():
        if len(sample) == RANGES * EACH and (ranges := len(found) // EACH) > 1:
            found.sort()
            out[group] = sorted({found[len(found) * i // ranges] for i in range(1, ranges)})
    return out


def _range_of(cuts: str) -> Column:
    """How many of the sorted cuts are at or below the key, by halving."""
    half = "cast((s.a + s.b) div 2 as int)"
    step = f"if(s.a >= s.b, s, if({cuts}[{half}] <= __key, named_struct('a', {half} + 1, 'b', s.b), named_struct('a', s.a, 'b', {half})))"
    return F.expr(f"coalesce(aggregate(sequence(0, {RANGES.bit_length()}), named_struct('a', 0, 'b', size({cuts})), (s, i) -> {step}, s -> s.a), 0)")


def asof_join(left: DataFrame, right: DataFrame, on: str | tuple[str, str], by: Sequence[str | tuple[str, str]] = (), take: Sequence[str] | None = None, direction: str = "backward", within: Column | None = None, strict: bool = False, how: str = "left", order: Sequence[str] = ()) -> DataFrame:
    """left's rows and columns with the columns `take` (all but `by` where left out) of the right row of the same group whose
    key is the largest at or below the left key; forward: the smallest at or above it; nearest: the closer of the two, the
    earlier one if both are as close. strict: without equal keys. within: the greatest distance, a number or an interval as
    a column. how: left keeps rows without a match, with nulls; inner drops them.

    Of right rows of one group and key the one with the largest values of `order`, then of `take`, counts. Rows with a null
    in a key or a group column match nothing; on the left they stay (how=left). NaN is the largest key. Left rows that
    repeat stay as often. Columns of `take` that left has too must be renamed first: a ValueError says so."""
    if direction not in ("backward", "forward", "nearest") or how not in ("left", "inner"):
        raise ValueError(f"direction {direction!r}, how {how!r}")
    left_key, right_key = (on, on) if isinstance(on, str) else on
    pairs = _named(by)
    take = [c for c in right.columns if c not in {r for _, r in pairs}] if take is None else list(take)
    if both := {c.lower() for c in take} & {c.lower() for c in left.columns}:
        raise ValueError(f"columns of both sides: {', '.join(sorted(both))}")
    if direction == "nearest":
        return _nearest(left, right, (left_key, right_key), pairs, take, within, strict, how, order)

    groups = [f"__g{i}" for i in range(len(pairs))]
    sound = _all([F.col(f"`{n}`").isNotNull() for n in (left_key, *(x for x, _ in pairs))])
    lefts = left.where(sound).select(*(F.col(f"`{n}`").alias(g) for (n, _), g in zip(pairs, groups, strict=True)), F.col(f"`{left_key}`").alias("__key"), F.struct(*map(_quoted, left.columns)).alias("__payload"))
    rights = right.where(_all([F.col(f"`{n}`").isNotNull() for n in (right_key, *(x for _, x in pairs))])).select(*(F.col(f"`{n}`").alias(g) for (_, n), g in zip(pairs, groups, strict=True)), F.col(f"`{right_key}`").alias("__key"), F.struct(*map(_quoted, take)).alias("__right"), F.struct(F.lit(0), *map(_quoted, order)).alias("__order"))
    # one right row for each group and key
    rights = rights.groupBy(*groups, "__key").agg(F.max(F.struct("__order", "__right")).alias("m")).select(*groups, "__key", F.col("m.__right").alias("__right"))
    kinds = dict(zip(["__payload", "__right"], [lefts.schema["__payload"].dataType, rights.schema["__right"].dataType], strict=True))
    rows = lefts.withColumn("__right", F.lit(None).cast(kinds["__right"])).unionByName(rights.withColumn("__payload", F.lit(None).cast(kinds["__payload"])))

    cuts = _cuts(lefts, groups)
    spark, kind = left.sparkSession, lefts.schema["__key"].dataType
    of = None
    if not cuts:
        rows = rows.withColumn("__range", F.lit(0))
    elif not groups:
        own = cuts[()]
        rows = rows.withColumn("__cuts", F.array(*(F.lit(str(c)).cast(kind) for c in own))).withColumn("__range", _range_of("__cuts")).drop("__cuts")
        every = spark.range(len(own) + 1).select(F.col("id").cast("int").alias("__range"))
    else:
        schema = T.StructType([*(lefts.schema[g] for g in groups), T.StructField("__cuts", T.ArrayType(kind))])
        of = F.broadcast(spark.createDataFrame([(*g, c) for g, c in cuts.items()], schema))  # RANGES groups and RANGES * EACH keys at most
        rows = rows.join(of, groups, "left").withColumn("__range", _range_of("__cuts")).drop("__cuts")
        every = of.select(*groups, F.explode(F.expr("sequence(0, size(__cuts))")).alias("__range"))

    back = direction == "backward"
    # equal keys: right rows come first, so that left rows see them; behind them if strict
    side = F.col("__payload").isNull() if strict else F.col("__payload").isNotNull()
    order_by = [F.asc("__key") if back else F.desc("__key"), side.cast("int")]
    here = Window.partitionBy("__range", *groups).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("__right").isNotNull(), F.struct(F.col("__key").alias("key"), F.col("__right").alias("row")))
    rows = rows.withColumn("__found", F.last(seen, ignorenulls=True).over(here))
    if cuts:
        # each range's last right row, and for the ranges after it the last one before them
        ends = rows.where(F.col("__right").isNotNull()).groupBy("__range", *groups).agg((F.max if back else F.min)(F.struct(F.col("__key").alias("key"), F.col("__right").alias("row"))).alias("__end"))
        every = every.join(ends if of is None else ends.join(of.select(*groups), groups), ["__range", *groups], "left")
        before = Window.partitionBy(*groups).orderBy(F.asc("__range") if back else F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select("__range", *groups, F.last("__end", ignorenulls=True).over(before).alias("__carried"))
        rows = rows.where(F.col("__payload").isNotNull()).join(F.broadcast(carried), ["__range", *groups], "left")  # a row for each range
        rows = rows.withColumn("__found", F.coalesce("__found", "__carried"))
    else:
        rows = rows.where(F.col("__payload").isNotNull())
    if within is not None:
        near = (F.col("__found.key") >= F.col("__key") - within) if back else (F.col("__found.key") <= F.col("__key") + within)
        rows = rows.withColumn("__found", F.when(near, F.col("__found")))
    if how == "inner":
        rows = rows.where(F.col("__found").isNotNull())
    out = rows.select(*(F.col("__payload")[c].alias(c) for c in left.columns), *(F.col("__found.row")[c].alias(c) for c in take))
    if how == "inner":
        return out
    rest = left.where(~sound).select(*map(_quoted, left.columns), *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take))
    return out.unionByName(rest)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`").alias(name)


def _nearest(left: DataFrame, right: DataFrame, on: tuple[str, str], by: list[tuple[str, str]], take: list[str], within: Column | None, strict: bool, how: str, order: Sequence[str]) -> DataFrame:
    """Backward and forward, one after the other; the closer one of the two."""
    packed = lambda name: right.select(*{r for _, r in by}, F.col(on[1]).alias(f"__{name}_key"), F.struct(F.struct(*map(_quoted, order), F.lit(0)).alias("order"), F.struct(*map(_quoted, take)).alias("row")).alias(f"__{name}"))
    rows = asof_join(left, packed("back"), (on[0], "__back_key"), by, ["__back_key", "__back"], "backward", within, strict, order=["__back"])
    rows = asof_join(rows, packed("on"), (on[0], "__on_key"), by, ["__on_key", "__on"], "forward", within, strict, order=["__on"])
    key = F.col(on[0])
    forward = F.col("__on_key").isNotNull() & (F.col("__back_key").isNull() | (F.col("__on_key") - key < key - F.col("__back_key")))
    rows = rows.withColumn("__row", F.when(forward, F.col("__on.row")).otherwise(F.col("__back.row")))
    if how == "inner":
        rows = rows.where(F.col("__row").isNotNull())
    return rows.select(*map(_quoted, left.columns), *(F.col("__row")[c].alias(c) for c in take))


def position(name: str, kind: str) -> Column:
    """A column as a double in its order: dates in days, timestamps in seconds."""
    if kind in ("timestamp", "timestamp_ntz"):
        return F.expr(f"timestampdiff(MICROSECOND, {kind}'1970-01-01 00:00:00', `{name}`) / 1e6D")
    if kind == "date":
        return F.expr(f"cast(datediff(`{name}`, date'1970-01-01') as double)")
    return F.col(f"`{name}`").cast("double")


def interval_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, by: Sequence[str | tuple[str, str]] = (), closed: str = "left", how: str = "inner") -> DataFrame:
    """Each left row with each right row of the same group whose interval low .. high holds its point. closed: which ends
    belong to it, left, right, both or neither. how: left keeps points without an interval, with nulls.

    Intervals of a length in (2 ** (l - 1), 2 ** l] lie in one or two bins of 2 ** l; a point has one bin of each l that
    occurs (some dozens), so rows multiply by the lengths' magnitudes, not by the intervals' lengths. Nulls and NaN in point, ends or groups
    match nothing. Intervals that end before they begin are empty; one of a single point holds it if closed is both. Columns that
    both sides have, but for those of `by` with one name, must be renamed first."""
    if closed not in ("left", "right", "both", "neither") or how not in ("inner", "left"):
        raise ValueError(f"closed {closed!r}, how {how!r}")
    pairs = _named(by)
    same = [a for a, b in pairs if a == b]
    if both := {c.lower() for c in left.columns} & {c.lower() for c in right.columns if c not in same}:
        raise ValueError(f"columns of both sides: {', '.join(sorted(both))}")
    at = position(point, left.schema[point].dataType.simpleString())
    a, b = (position(c, right.schema[c].dataType.simpleString()) for c in (low, high))
    # no shorter than what doubles tell apart there, so that bins stay whole numbers below 2 ** 53
    size = F.greatest(F.col("__high") - F.col("__low"), F.abs("__low") * 2.0**-52, F.abs("__high") * 2.0**-52, F.lit(1e-290))
    spans = right.withColumns({"__low": _finite(a), "__high": _finite(b)}).where("__low <= __high").withColumn("__size", F.ceil(F.log2(size)).cast("int"))
    spans = spans.withColumn("__bin", F.explode(F.array_distinct(F.array(_bin("__low", "__size"), _bin("__high", "__size")))))
    often = {r[0]: r[1] for r in spans.groupBy("__size").count().collect()}  # magnitudes of doubles: 2,098 at most, few in practice
    sizes = sorted(often)
    spans = F.broadcast(spans) if sum(often.values()) <= FEW else spans.hint("merge")
    points = left.withColumn("__at", _finite(at)).withColumn("__size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.expr("cast(array() as array<int>)")))
    points = points.where("__at is not null").withColumn("__bin", _bin("__at", "__size"))
    l, r = points.alias("l"), spans.alias("r")
    meets = (F.col("l.__size") == F.col("r.__size")) & (F.col("l.__bin") == F.col("r.__bin"))
    for x, y in pairs:
        meets &= F.col(f"l.`{x}`") == F.col(f"r.`{y}`")
    p, from_, to = F.col(f"l.`{point}`"), F.col(f"r.`{low}`"), F.col(f"r.`{high}`")
    meets &= (p >= from_) if closed in ("left", "both") else (p > from_)
    meets &= (p <= to) if closed in ("right", "both") else (p < to)
    beside = [c for c in right.columns if c not in same]
    found = l.join(r, meets).select(*(F.col(f"l.`{c}`").alias(c) for c in left.columns), *(F.col(f"r.`{c}`").alias(c) for c in beside))
    if how == "inner":
        return found
    # whether a point lies in an interval depends on its value and group alone
    names = [point, *(x for x, _ in pairs)]
    met = found.select(*(F.col(f"`{n}`").alias(f"__m{i}") for i, n in enumerate(names))).distinct().hint("merge")
    alone = left.join(met, _all([F.col(f"`{n}`").eqNullSafe(F.col(f"__m{i}")) for i, n in enumerate(names)]), "left_anti")
    return found.unionByName(alone.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in beside)))


def _finite(x: Column) -> Column:
    """Within what halves of doubles hold; NaN as null."""
    return F.when(~F.isnan(x), F.greatest(F.least(x, F.lit(8e307)), F.lit(-8e307)))


def _bin(at: str, size: str) -> Column:
    # doubles: beyond 2 ** 53 bins are rounded alike for all that lie in them
    return F.expr(f"({at} / pow(2D, {size})) - pmod({at} / pow(2D, {size}), 1D)")


def overlap_join(left: DataFrame, right: DataFrame, spans: tuple[str, str], others: tuple[str, str], by: Sequence[str | tuple[str, str]] = ()) -> DataFrame:
    """Pairs of a left and a right row of the same group whose half-open intervals share a point: one's beginning lies in the other."""
    (a, b), (c, d) = spans, others
    lefts, rights = left.where(F.col(a) < F.col(b)), right.where(F.col(c) < F.col(d))
    pairs = _named(by)
    inside = interval_join(lefts, rights, a, c, d, pairs)
    around = interval_join(rights, lefts, c, a, b, [(y, x) for x, y in pairs], closed="neither")
    return inside.unionByName(around)
