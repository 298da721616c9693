"""Statements: wide tables of labels by periods, kept long so that every lookup is one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning, routing


def _col(c: str):
    return F.col("`" + c.replace("`", "``") + "`")


def long(df: DataFrame, label: str, periods: list[str], order: str | None = None) -> DataFrame:
    """label, period, value, and, with the column that orders rows, row_idx and col_pos."""
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.lit(i).alias("col_pos"), cleaning.currency(_col(p).cast("string")).alias("value")) for i, p in enumerate(periods)))).alias("p")
    rows = df.select(*([_col(order).alias("row_idx")] if order else []), _col(label).cast("string").alias("label"), pairs)
    return rows.select(*(["row_idx", "p.col_pos"] if order else []), "label", "p.period", "p.value")


def wide(df: DataFrame, periods: list) -> DataFrame:
    """One column for each of the periods, from label, period, value."""
    return df.groupBy("label").agg(*(F.sum(F.when(F.col("period") == p, F.col("value"))).alias(f"p{p}") for p in periods))


def growth(df: DataFrame) -> DataFrame:
    """Each period's value, the one before, and the change in %; null where there is nothing to compare with."""
    before = F.lag("value").over(Window.partitionBy("label").orderBy("period"))
    return df.withColumn("before", before).withColumn("growth_pct", F.round(F.try_divide(F.col("value") - F.col("before"), F.abs("before")) * 100, 2))


def row_total(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.sum("value").alias("total"), F.count_if(F.col("value") != 0).alias("periods"))


def latest(df: DataFrame) -> DataFrame:
    """Each label's last period whose value isn't zero or null."""
    return df.where("value <> 0").groupBy("label").agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"))


def change(df: DataFrame, before: str, now: str) -> DataFrame:
    """label, change of each label from one period to another; those without either are left out."""
    at = lambda p: F.max(F.when(F.lower("period") == p.lower(), F.col("value")))
    return df.groupBy("label").agg(F.round(at(now) - at(before), 2).alias("change")).where("change is not null")


def ratios(df: DataFrame) -> DataFrame:
    """Margins and interest coverage by period from long rows of the usual labels."""
    get = lambda name: F.max(F.when(F.lower("label") == name, F.col("value")))
    row = df.groupBy("period").agg(*(get(n).alias(n.replace(" ", "_")) for n in ("revenue", "gross profit", "ebitda", "net profit", "interest expense")))
    share = lambda c: F.bround(F.try_divide(F.col(c), F.col("revenue")) * 100, 2)
    return row.select("period", share("gross_profit").alias("gross_margin"), share("ebitda").alias("ebitda_margin"), share("net_profit").alias("net_margin"), F.bround(F.try_divide("ebitda", "interest_expense"), 2).alias("interest_coverage"))


def overview(df: DataFrame, most: int = 6) -> DataFrame:
    """row_idx, label, value of the first `most` rows whose label names a metric: each one's last value that isn't zero."""
    metric = F.size(routing.metric_categories(F.col("label"))) > 0
    told = df.where(metric & ~F.lower(F.trim("label")).isin("nan", "none", "", "na") & (F.col("value") != 0))
    last = told.groupBy("row_idx", "label").agg(F.round(F.max_by("value", "col_pos"), 2).alias("value"))
    return last.orderBy("row_idx").limit(most)


def around(df: DataFrame, order: str, place: int, reach: int = 2) -> DataFrame:
    """The rows up to `reach` before and behind a row."""
    return df.where(_col(order).between(place - reach, place + reach)).orderBy(order)


def named(df: DataFrame, label: str) -> DataFrame:
    """The rows whose label is a name: not empty, not a number."""
    c = F.trim(_col(label).cast("string"))
    bare = F.regexp_replace(c, ",", "").try_cast("double")
    return df.where(c.isNotNull() & ~F.lower(c).isin("nan", "none", "", "na") & bare.isNull())
