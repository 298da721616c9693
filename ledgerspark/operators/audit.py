"""Audit tools: Benford's law, cohorts, three-way match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL, DEVIATION, ENOUGH = 15.51, 0.02, 100  # fixed values: chi square at 8 degrees of freedom and 5 %
#: The expected shares of first digits from 1 to 9.
EXPECTED = [0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046]


def first_digit(c: Column) -> Column:
    """The first digit that isn't 0; null for zero and null. By text: logarithms are off for some decimals."""
    digit = F.regexp_extract(F.abs(c).cast("string"), "[1-9]", 0)
    return F.when(digit != "", digit.cast("int"))


def benford_digits(df: DataFrame, column: str) -> DataFrame:
    """digit, n, share, expected for 1 to 9, also for digits that don't occur."""
    found = df.select(first_digit(F.col(column).try_cast("double")).alias("digit")).where("digit is not null").groupBy("digit").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    n = F.coalesce("n", F.lit(0))
    share = F.coalesce(F.try_divide(n, F.sum(n).over(Window.partitionBy())), F.lit(0.0))
    return every.join(found, "digit", "left").select("digit", n.alias("n"), share.alias("share"), F.element_at(F.array(*map(F.lit, EXPECTED)), F.col("digit")).alias("expected"))


def benford_verdict(df: DataFrame, column: str, threshold: float = DEVIATION) -> DataFrame:
    """n, chi_square, deviations, verdict: pass, warning or fail. n counts all numbers, zeros too; shares are of those that
    have a first digit. Chi square is null, as it isn't judged, for under ENOUGH numbers."""
    digits = benford_digits(df, column).agg(F.sum((F.col("share") - F.col("expected")) ** 2 / F.col("expected")).alias("distance"), F.count_if(F.abs(F.col("share") - F.col("expected")) > threshold).alias("deviations"))
    total = df.agg(F.count(F.col(column).try_cast("double")).alias("n"))
    joined = total.join(F.broadcast(digits), F.lit(True))  # one row each
    few, chi = F.col("n") < ENOUGH, F.col("n") * F.col("distance")
    verdict = F.when(few, "warning").when((chi > CRITICAL) | (F.col("deviations") > 2), "fail").when(F.col("deviations") > 0, "warning").otherwise("pass")
    return joined.select("n", F.when(~few, F.round(chi, 4)).alias("chi_square"), F.when(~few, F.col("deviations")).alias("deviations"), verdict.alias("verdict"))


def cohorts(df: DataFrame, user: str, date: str, period: str = "month", by: str = "calendar") -> DataFrame:
    """cohort, offset, users: distinct users by the period of their first row and periods since then; by="days" counts
    periods of 7, 30 or 90 days instead of the calendar's."""
    rows = df.select(F.col(user).alias("user"), F.date_trunc(period, F.col(date)).alias("at")).where("user is not null and at is not null").distinct()
    rows = rows.withColumn("cohort", F.min("at").over(Window.partitionBy("user")))
    days = F.datediff("at", "cohort")
    if by == "days" or period == "week":
        offset = F.floor(days / {"week": 7, "month": 30, "quarter": 90, "year": 360}[period])
    else:
        months = (F.year("at") - F.year("cohort")) * 12 + F.month("at") - F.month("cohort")
        offset = F.floor(months / {"month": 1, "quarter": 3, "year": 12}[period])
    return rows.groupBy(F.to_date("cohort").alias("cohort"), offset.cast("int").alias("offset")).agg(F.count_distinct("user").alias("users"))


def retention(df: DataFrame, user: str, date: str, period: str = "month", by: str = "calendar") -> DataFrame:
    """cohort, offset, users, retention in % of the cohort's first period."""
    size = F.first("users").over(Window.partitionBy("cohort").orderBy("offset"))
    return cohorts(df, user, date, period, by).withColumn("retention", F.round(F.col("users") / size * 100, 2))


def average_retention(df: DataFrame, user: str, date: str, period: str = "month") -> DataFrame:
    """offset, retention: the mean over cohorts for each period after the first; of whole hundredths, so that it doesn't
    depend on the order of a sum."""
    found = retention(df, user, date, period).where("offset > 0")
    return found.groupBy("offset").agg(F.expr("cast((2 * sum(cast(round(retention * 100) as bigint)) + count(*)) div (2 * count(*)) as double) / 100").alias("retention"))


def cohort_matrix(df: DataFrame, user: str, date: str, period: str, offsets: int) -> DataFrame:
    """cohort and a column p0 … of users for each of the first `offsets` periods, null where nobody came back."""
    return cohorts(df, user, date, period).groupBy("cohort").agg(*(F.max(F.when(F.col("offset") == i, F.col("users"))).alias(f"p{i}") for i in range(offsets)))


def cohort_values(df: DataFrame, user: str, date: str, value: str, period: str = "month") -> DataFrame:
    """cohort, offset, value: what each cohort's users brought by period since their first one."""
    rows = df.select(F.col(user).alias("user"), F.date_trunc(period, F.col(date)).alias("at"), F.col(value).cast("double").alias("v")).where("user is not null and at is not null")
    rows = rows.groupBy("user", "at").agg(F.sum("v").alias("v")).withColumn("cohort", F.min("at").over(Window.partitionBy("user")))
    months = (F.year("at") - F.year("cohort")) * 12 + F.month("at") - F.month("cohort")
    offset = F.floor(F.datediff("at", "cohort") / 7) if period == "week" else F.floor(months / {"month": 1, "quarter": 3, "year": 12}[period])
    return rows.groupBy(F.to_date("cohort").alias("cohort"), offset.cast("int").alias("offset")).agg(F.sum("v").alias("value"))


def column_like(columns: list[str], *targets: str) -> str | None:
    """The first column whose name holds the first target that any name holds, without regard to case."""
    return next((c for t in targets for c in columns if t.lower() in c.lower()), None)


#: How amounts and ids of each side are called, in order.
SIDES = {"invoice": (("invoice_id", "id"), ("amount", "total")), "po": (("po", "invoice_id"), ("amount", "total")), "ledger": (("invoice_id", "ref"), ("amount", "debit"))}


def side(df: DataFrame, name: str) -> DataFrame:
    """id, amount, row_idx of one of the three documents, by its columns' usual names."""
    ids, amounts = (column_like(df.columns, *names) for names in SIDES[name])
    if ids is None or amounts is None:
        raise ValueError(f"no column of ids or amounts for {name} among {df.columns}")
    row = F.col("row_idx") if "row_idx" in df.columns else F.lit(0)
    return df.select(F.col(ids).cast("string").alias("id"), F.col(amounts).try_cast("double").alias("amount"), row.alias("row_idx"))


def three_way_match(invoices: DataFrame, orders: DataFrame, ledger: DataFrame, tolerance: float = 0.01, unmatched: bool = True) -> DataFrame:
    """id, invoice, po, ledger, status, from frames of (id, amount) and, for their order, row_idx. Of several rows with an
    id the first counts (by amount if there is no row_idx); invoices without id or amount are left out. A status is what
    differs by more than the tolerance, relative to the invoice: invoice_po_mismatch, invoice_ledger_mismatch,
    three_way_mismatch, else matched. What has no partner can't differ; with `unmatched` it's named instead, and negative
    invoices are judged by their size, which otherwise always differ."""

    def one(df: DataFrame, name: str) -> DataFrame:
        row = F.col("row_idx") if "row_idx" in df.columns else F.lit(0)
        rows = df.select(F.col("id").cast("string").alias("id"), F.col("amount").try_cast("double").alias(name), row.alias("row_idx"))
        return rows.where("id is not null").groupBy("id").agg(F.min(F.struct("row_idx", name)).alias("m")).select("id", F.col(f"m.{name}").alias(name))

    joined = invoices.select(F.col("id").cast("string").alias("id"), F.col("amount").try_cast("double").alias("invoice")).where("id is not null and invoice is not null and not isnan(invoice)")
    joined = joined.join(one(orders, "po"), "id", "left").join(one(ledger, "ledger"), "id", "left")
    room = (F.abs("invoice") if unmatched else F.col("invoice")) * tolerance
    off = lambda c: F.coalesce(F.abs(F.col(c) - F.col("invoice")) > room, F.lit(False))
    status = F.when(off("po") & off("ledger"), "three_way_mismatch").when(off("po"), "invoice_po_mismatch").when(off("ledger"), "invoice_ledger_mismatch")
    if unmatched:
        status = status.when(F.col("po").isNull(), "unmatched_po").when(F.col("ledger").isNull(), "unmatched_ledger")
    return joined.withColumn("status", status.otherwise("matched"))


def match_verdict(matched: DataFrame) -> DataFrame:
    """matched, unmatched, total, match_rate in %, verdict: pass from 95 %, warning from 80 %, else fail."""
    row = matched.agg(F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") != "matched").alias("unmatched"))
    total = F.col("matched") + F.col("unmatched")
    rate = F.col("matched") / F.greatest(total, F.lit(1))
    verdict = F.when(rate >= 0.95, "pass").when(rate >= 0.8, "warning").otherwise("fail")
    return row.select("matched", "unmatched", total.alias("total"), F.round(rate * 100, 2).alias("match_rate"), verdict.alias("verdict"))


def discrepancies(matched: DataFrame, k: int = 20) -> DataFrame:
    """id, status, difference of the first k that differ, by id; the difference is to the order, or else to the ledger."""
    off = F.col("status").isin("invoice_po_mismatch", "invoice_ledger_mismatch", "three_way_mismatch")
    other = F.when(F.col("status") == "invoice_ledger_mismatch", F.col("ledger")).otherwise(F.col("po"))
    return matched.where(off).select("id", "status", F.round(F.abs(F.col("invoice") - other), 2).alias("difference")).orderBy("id").limit(k)
