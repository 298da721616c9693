"""Approximate aggregates that merge: distinct counts and quantiles by day, added up to any span of days.

A day's row holds a HyperLogLog sketch for each column whose distinct values are counted and a KLL sketch for each one whose
quantiles are asked for, by group. Rows are small and of bounded size, so days are kept, replaced one by one when late rows
come, and merged instead of read again. Merged sketches have the registers of one over all rows, but another estimator,
so numbers differ a little by how rows were divided, within the stated bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: HyperLogLog with 2 ** LOG_K registers: a standard error of about 1.04 / 2 ** (LOG_K / 2), times three for 99.7 %.
LOG_K = 12
#: KLL's size; its ranks are off by at most about this share, with 99 %.
KLL_K, RANK_ERROR = 200, 0.0265
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LOG_K)


def by_day(rows: DataFrame, time: str, group: Sequence[str] = (), distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """day, the group, n (rows), d_<column> and q_<column>: one row for each day and group. Nulls aren't counted; rows
    without a time are under a null day."""
    counted = [F.hll_sketch_agg(F.col(c).cast("string"), LOG_K).alias(f"d_{c}") for c in distinct]
    ranked = [F.kll_sketch_agg_double(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(KLL_K)).alias(f"q_{c}") for c in quantiles]
    return rows.groupBy(F.to_date(time).alias("day"), *group).agg(F.count("*").alias("n"), *counted, *ranked)


def merged(days: DataFrame, group: Sequence[str | Column] = ()) -> DataFrame:
    """The group, n and the same sketches for all rows of by_day() or of merged() together."""
    names = [c for c in days.columns if c[:2] in ("d_", "q_")]
    of = {"d": lambda c: F.hll_union_agg(c), "q": lambda c: F.kll_merge_agg_double(c, F.lit(KLL_K))}
    return days.groupBy(*group).agg(F.sum("n").alias("n"), *(of[c[0]](c).alias(c) for c in names))


def distinct_of(column: str) -> Column:
    """The number of distinct values in a d_ column, about."""
    return F.hll_sketch_estimate(F.col(f"d_{column}"))


def quantile_of(column: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(f"q_{column}"), F.lit(share))


def replaced(kept: DataFrame, days: DataFrame) -> DataFrame:
    """The kept rows, those of the days that came anew replaced as a whole."""
    return kept.join(days.select(F.col("day").alias("__day")).distinct(), F.col("day").eqNullSafe(F.col("__day")), "left_anti").unionByName(days)
