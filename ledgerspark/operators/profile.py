"""Profiles of tables; each function is one or two aggregations over all columns at once."""

from __future__ import annotations

import math
import re
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ledgerspark.functions.routing import METRICS

def _col(c: str):
    return F.col("`" + c.replace("`", "``") + "`")


def _by_column(df: DataFrame, columns: list[str], **measures) -> DataFrame:
    row = df.agg(*(f(c).alias(f"{m}__{i}") for i, c in enumerate(columns) for m, f in measures.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{m}__{i}").alias(m) for m in measures)) for i, c in enumerate(columns)))).alias("r")).select("r.*")


def mean(c: str):
    """The mean to six places by a sum of whole millionths, which doesn't depend on the order; of numbers beyond 10 ** 12
    as doubles."""
    q = "`" + c.replace("`", "``") + "`"
    total = f"sum(cast(round({q} * 1000000) as decimal(38,0)))"
    exact = f"sign({total}) * ((2 * abs({total}) + count({q})) div (2 * count({q}))) / 1000000"
    return F.expr(f"case when abs(avg({q})) < 1e12 then cast({exact} as double) else avg({q}) end")


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """column, non_null, null_pct, low, high, mean, distinct."""
    return _by_column(df, names, non_null=lambda c: F.count(_col(c)), null_pct=lambda c: F.round((1 - F.count(_col(c)) / F.count(F.lit(1))) * 100, 2), low=lambda c: F.min(_col(c)).cast("double"), high=lambda c: F.max(_col(c)).cast("double"), mean=mean, distinct=lambda c: F.count_distinct(_col(c)))


def shape(df: DataFrame, names: list[str]) -> DataFrame:
    """Sample skewness and excess kurtosis, of eight values or more; Spark's own are of the population."""
    moments = _by_column(df, names, n=lambda c: F.count(_col(c)).cast("double"), g1=lambda c: F.skewness(_col(c)), g2=lambda c: F.kurtosis(_col(c)))
    n = F.col("n")
    return moments.where("n >= 8").select("column", F.round(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2), 6).alias("skew"), F.round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6), 6).alias("kurtosis"))


def labelled_shape(df: DataFrame, names: list[str]) -> DataFrame:
    """shape() with what it looks like."""
    look = F.when(F.abs("skew") < 0.5, "symmetric").when(F.col("skew") > 0, "right-skewed").otherwise("left-skewed")
    tail = F.when(F.col("kurtosis") > 3, "heavy-tailed").when(F.col("kurtosis") < -1, "light-tailed").otherwise("normal-tailed")
    return shape(df, names).select("column", "skew", "kurtosis", look.alias("shape"), tail.alias("tail"))


def quantiles(df: DataFrame, names: list[str], shares: tuple[float, ...], bins: int = 1024) -> dict[str, list[float]]:
    """By column, exact quantiles by interpolation, of doubles; no entry for a column without values.

    Nothing is sorted and no value is shuffled: each pass counts the values of a range that holds a wanted rank in bins of
    equal width, and the next one looks at the bin that holds it, until that is one value. A pass is an aggregation with
    at most `bins` rows for each rank; passes are a few, as each narrows the range by about `bins`."""
    value = {c: _col(c).cast("double") for c in names}
    held = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    row = df.agg(*(f(held[c]).alias(f"{m}{i}") for i, c in enumerate(names) for m, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    size = {c: row[f"n{i}"] for i, c in enumerate(names) if row[f"n{i}"]}
    at = {c: [s * (n - 1) for s in shares] for c, n in size.items()}
    # (column, rank) -> lowest and highest value that it may have, and how many values lie below
    state = {(c, r): (row[f"lo{names.index(c)}"], row[f"hi{names.index(c)}"], 0) for c, places in at.items() for x in places for r in (math.floor(x), math.ceil(x))}
    while ranges := sorted({(c, lo, hi) for (c, _), (lo, hi, _) in state.items() if lo < hi}):
        bin_of = lambda c, lo, hi: F.least(F.floor((held[c] - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        places = [F.when((held[c] >= lo) & (held[c] <= hi), F.struct(F.lit(k).alias("k"), bin_of(c, lo, hi).alias("bin"), held[c].alias("v"))) for k, (c, lo, hi) in enumerate(ranges)]
        counted = df.select(F.explode(F.array_compact(F.array(*places))).alias("p")).groupBy("p.k", "p.bin").agg(F.count("*").alias("n"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi"))
        found: dict[int, list] = {}
        for r in counted.collect():  # at most `bins` rows for each range
            found.setdefault(r.k, []).append((r.bin, r.n, r.lo, r.hi))
        for (c, rank), (lo, hi, below) in list(state.items()):
            if lo < hi:
                for _, n, new_lo, new_hi in sorted(found[ranges.index((c, lo, hi))]):
                    if rank < below + n:
                        state[c, rank] = (new_lo, new_hi, below)
                        break
                    below += n
    low = lambda c, x: state[c, math.floor(x)][0]
    return {c: [low(c, x) + (x - math.floor(x)) * (state[c, math.ceil(x)][0] - low(c, x)) for x in places] for c, places in at.items()}


class Limits(NamedTuple):
    q1: float
    q3: float
    under: float
    over: float


def _fences(df: DataFrame, names: list[str], fence: float) -> dict[str, Limits]:
    return {c: Limits(a, b, a - fence * (b - a), b + fence * (b - a)) for c, (a, b) in quantiles(df, names, (0.25, 0.75)).items()}


def outliers(df: DataFrame, names: list[str], fence: float = 1.5) -> DataFrame:
    """column, q1, q3, low, high: quartiles by interpolation, and how many values lie beyond the fences."""
    limits = _fences(df, names, fence)
    told = [c for c in names if c in limits]
    if not told:
        return df.sparkSession.createDataFrame([], "column string, q1 double, q3 double, low long, high long")
    out = lambda c, side: F.count_if(_col(c).cast("double") < limits[c].under) if side == "low" else F.count_if(_col(c).cast("double") > limits[c].over)
    return _by_column(df, told, q1=lambda c: F.lit(limits[c].q1), q3=lambda c: F.lit(limits[c].q3), low=lambda c: out(c, "low"), high=lambda c: out(c, "high")).where("q1 is not null")


def outlier_rows(df: DataFrame, names: list[str], row: str, k: int = 5, fence: float = 1.5) -> DataFrame:
    """column, row, value, dir of the first k outliers of each column, by the row's key; none in a column of under four values
    or without spread."""
    limits = _fences(df, names, fence)
    counts = df.agg(*(F.count(_col(c)).alias(str(i)) for i, c in enumerate(names))).first()
    told = [c for i, c in enumerate(names) if c in limits and counts[i] >= 4 and limits[c].q3 > limits[c].q1]
    if not told:
        return df.sparkSession.createDataFrame([], f"column string, row {dict(df.dtypes)[row]}, value double, dir string")
    way = lambda c: F.when(_col(c).cast("double") < limits[c].under, "LOW").when(_col(c).cast("double") > limits[c].over, "HIGH")
    found = df.select(_col(row).alias("row"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(_col(c).cast("double"), 2).alias("value"), way(c).alias("dir")) for c in told))).alias("o")).select("row", "o.*").where("dir is not null")
    rank = F.row_number().over(Window.partitionBy("column").orderBy("row", "value"))
    return found.withColumn("n", rank).where(F.col("n") <= k).select("column", "row", "value", "dir")


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    pairs = list(combinations(names, 2))
    row = df.agg(*(F.corr(_col(a), _col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")


def strong_correlations(df: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """a, b, r, strength of the k pairs that correlate most, above 0.5."""
    found = correlations(df, names).where("abs(r) > 0.5 and not isnan(r)")
    strength = F.when(F.abs("r") > 0.8, "strong").otherwise("moderate")
    return found.select("a", "b", F.round("r", 3).alias("r"), strength.alias("strength")).orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def top_values(df: DataFrame, names: list[str], k: int = 3) -> DataFrame:
    """The k most frequent values of each column, ties by value, in one pass over the table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _col(c).cast("string").alias("value")) for c in names))).alias("p")
    counted = df.select(pairs).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("column", "value", "n")


def quality(df: DataFrame, names: list[str]) -> DataFrame:
    """column, completeness, consistency, outlier_free, quality: shares in % of values that aren't null, that are of the
    more common kind (text columns: numbers or not), that lie inside the fences; their sum weighs 0.5, 0.25, 0.25. Each is
    rounded to one place."""
    kinds = dict(df.dtypes)
    numbers = [c for c in names if isinstance(df.schema[c].dataType, NumericType)]
    limits = _fences(df, numbers, 1.5) if numbers else {}
    n = F.count(F.lit(1))

    def consistent(c):
        if kinds[c] != "string":
            return F.lit(100.0)
        share = F.count(_col(c).try_cast("double")) / F.count(_col(c))
        return F.coalesce(F.round(F.greatest(share, 1 - share) * 100, 1), F.lit(100.0))

    def inside(c):
        if c not in limits or not limits[c].q3 > limits[c].q1:
            return F.lit(100.0)
        v = _col(c).cast("double")
        out = F.count_if((v < limits[c].under) | (v > limits[c].over))
        return F.when(F.count(v) >= 4, F.round((1 - out / F.count(v)) * 100, 1)).otherwise(100.0)

    found = _by_column(df, names, n=lambda c: n, completeness=lambda c: F.coalesce(F.round(F.try_divide(F.count(_col(c)), n) * 100, 1), F.lit(0.0)), consistency=consistent, outlier_free=inside)
    found = found.withColumn("consistency", F.when(F.col("n") > 0, F.col("consistency")).otherwise(0.0))
    score = F.when(F.col("n") > 0, F.round(F.col("completeness") * 0.5 + F.col("consistency") * 0.25 + F.col("outlier_free") * 0.25, 1)).otherwise(0.0)
    return found.select("column", "completeness", "consistency", "outlier_free", score.alias("quality"))


def grade(scores: DataFrame) -> DataFrame:
    """quality, completeness, grade: the means over columns; A from 90, B from 75, C from 60, else D."""
    mean_of = lambda c: F.expr(f"cast((2 * sum(cast(round({c} * 10) as bigint)) + count({c})) div (2 * count({c})) as double) / 10")
    q = F.col("quality")
    return scores.agg(mean_of("quality").alias("quality"), mean_of("completeness").alias("completeness")).withColumn("grade", F.when(q >= 90, "A").when(q >= 75, "B").when(q >= 60, "C").otherwise("D"))


def _words(patterns: list[str]) -> set[str]:
    return {w for p in patterns for w in re.sub(r"[^a-z0-9]+", " ", p.lower()).split() if len(w) >= 2}


#: Words of names of columns that hold times, ids, ratios beside those of METRICS.
TEMPORAL = {"fy", "quarter", "q1", "q2", "q3", "q4", "period", "date", "time", "year", "month", "day", "week", "half", "h1", "h2", "ytd", "mtd", "qtd", "9mfy", "3mfy", "6mfy"}
IDENTIFIER = {"id", "key", "code", "ref", "number", "no", "sr", "index"}
RATIO = {"roe", "roa", "roce", "eps", "pe", "pb", "npm", "opm", "margin", "pct", "percent", "%", "growth", "yield", "leverage", "debt_equity", "current_ratio", "quick_ratio"}


def classified(df: DataFrame, names: list[str] | None = None) -> dict[str, str]:
    """What each column is: temporal, identifier, ratio, financial_metric, dimension or metric; by its name, then by its
    range or number of different values. One aggregation."""
    names = names or df.columns
    ratio = RATIO | _words(METRICS["ratio"] + METRICS["performance"])
    money = set().union(*(_words(METRICS[k]) for k in ("revenue", "expense", "profit", "asset", "liability", "equity", "cashflow", "volume")))
    is_number = {c: isinstance(df.schema[c].dataType, NumericType) for c in names}
    is_text = {c: isinstance(df.schema[c].dataType, StringType) for c in names}
    measures = [m for i, c in enumerate(names) for m in ((F.min(_col(c)).cast("double").alias(f"a{i}"), F.max(_col(c)).cast("double").alias(f"b{i}")) if is_number[c] else (F.approx_count_distinct(_col(c)).alias(f"u{i}"),) if is_text[c] else ())]
    row = df.agg(F.count(F.lit(1)).alias("n"), *measures).first()
    out = {}
    for i, c in enumerate(names):
        tokens = set(re.split(r"[_\s\-\.]+", c.lower().replace(" ", "_")))
        low, high = (row[f"a{i}"], row[f"b{i}"]) if is_number[c] else (None, None)
        small = low is not None and low >= 0 and ((high <= 1 and high - low < 1) or (high <= 100 and "%" in c))
        if tokens & TEMPORAL:
            out[c] = "temporal"
        elif tokens & IDENTIFIER:
            out[c] = "identifier"
        elif tokens & ratio or small:
            out[c] = "ratio"
        elif tokens & money:
            out[c] = "financial_metric"
        elif is_text[c]:
            out[c] = "dimension" if row[f"u{i}"] < max(row.n * 0.5, 20) else "identifier"
        else:
            out[c] = "metric"
    return out


def hints(df: DataFrame, rows: int) -> list[str]:
    """What kind of statement the columns' names and the layout suggest."""
    low, out = [c.lower() for c in df.columns], []
    named = {c.replace(" ", "_") for c in low}
    if named & {"turnover"} or any("revenue" in c or "sales" in c for c in low):
        out.append("Layout: likely Income Statement / P&L data")
    if named & {"asset", "liability", "equity"} or any("balance" in c for c in low):
        out.append("Layout: likely Balance Sheet data")
    if any("cash" in c and "flow" in c for c in low):
        out.append("Layout: likely Cash Flow Statement data")
    if any(w in c for c in low for w in ("crore", "lakh", "inr", "₹", "rupee")):
        out.append("Currency: Indian Rupees (likely in Crores/Lakhs)")
    texts = sum(isinstance(f.dataType, StringType) for f in df.schema.fields)
    numbers = sum(isinstance(f.dataType, NumericType) for f in df.schema.fields)
    if len(low) > rows > 3 and texts <= 2 and numbers >= 3:
        out.append(f"Structure: transposed layout (metrics as rows, {numbers} period columns)")
    return out


def trends(df: DataFrame, label: str, before: str, now: str, order: str, rows: int = 15, k: int = 8) -> DataFrame:
    """label, growth_pct: change between two period columns of the first rows, where it's over 5 %; the first k."""
    some = df.orderBy(order).limit(rows)
    change = F.try_divide(F.col(now) - F.col(before), F.abs(before)) * 100
    return some.select(F.col(order), F.substring(F.col(label), 1, 40).alias("label"), change.alias("g")).where("abs(g) > 5").orderBy(order).limit(k).select("label", F.round("g", 1).alias("growth_pct"))


def scored_sheet(df: DataFrame) -> DataFrame:
    """score: how much a sheet looks like data: its density, up to 0.2 for number columns, up to 0.1 for rows, less for
    columns without names. 0 for an empty one."""
    width = len(df.columns)
    numbers = sum(isinstance(f.dataType, NumericType) for f in df.schema.fields)
    unnamed = sum(c.startswith("Unnamed") for c in df.columns) / max(width, 1)
    held = sum((F.count(_col(c)) for c in df.columns), F.lit(0))
    n = F.count(F.lit(1))
    score = F.try_divide(held, n * max(width, 1)) + min(numbers / max(width, 1) * 0.2, 0.2) + F.least(n / 1000, F.lit(0.1)) - unnamed * 0.3
    return df.agg(F.when(n > 0, F.round(score, 6)).otherwise(0.0).alias("score"))


def report(df: DataFrame, order: str | None = None, sample: int = 5, most: int = 50) -> str:
    """A table in words, for people or a language model: columns and what they are, quality, shapes, outliers,
    correlations, growth, hints, a sample. Everything but the sample comes from aggregates."""
    names = df.columns[:most]
    rows = df.count()
    if not rows:
        return "DataFrame is empty (0 rows × 0 columns)"
    kinds, types = classified(df, names), dict(df.dtypes)
    numbers = [c for c in names if isinstance(df.schema[c].dataType, NumericType)]
    texts = [c for c in names if isinstance(df.schema[c].dataType, StringType)]
    scores = {r.column: r for r in quality(df, names).collect()}
    stats = {r.column: r for r in columns(df, numbers).collect()} if numbers else {}
    often: dict[str, list[str]] = {}
    for r in sorted(top_values(df, texts).collect(), key=lambda r: (-r.n, r.value)) if texts else []:
        often.setdefault(r.column, []).append(r.value[:30])
    out = [f"DataFrame Shape: {rows} rows × {len(df.columns)} columns", "", "═══ COLUMN SCHEMA ═══"]
    for c in names:
        line = f"• {c} ({types[c]}) [{kinds[c]}]" + (f" ⚠Q:{scores[c].quality}" if scores[c].quality < 80 else "") + f" | {100 - scores[c].completeness:.1f}% null"
        if c in stats:
            line += f" | min={stats[c].low}, max={stats[c].high}, mean={stats[c]['mean']}"
        elif c in often:
            line += f" | Top: [{', '.join(often[c])}]"
        out.append(line)
    whole = grade(quality(df, names)).first()
    out += ["", "═══ DATA QUALITY ASSESSMENT ═══", f"Overall Quality: {whole.quality}/100 (Grade {whole.grade}) | Completeness: {whole.completeness}%"]
    told = [c for c in numbers if kinds[c] in ("metric", "financial_metric", "ratio")][:8]
    sections = {
        "DISTRIBUTION PROFILES": [f"{r.column}: {r['shape']}, {r.tail} (skew={r['skew']}, kurt={r['kurtosis']})" for r in labelled_shape(df, told).collect()] if told else [],
        "OUTLIER FLAGS (IQR Method)": [f"{r.column}: {r.low + r.high} outlier(s)" for r in outliers(df, numbers).collect() if r.low + r.high][:10] if numbers else [],
        "CORRELATION INSIGHTS": [f"{r.a} ↔ {r.b}: r={r.r} ({r.strength})" for r in strong_correlations(df, numbers).collect()] if len(numbers) > 1 and rows >= 5 else [],
        "FINANCIAL INTELLIGENCE": hints(df, rows),
        "DETECTED PATTERNS": [f"{k}: {[c for c in names if kinds[c] == k][:10]}" for k in ("temporal", "identifier", "financial_metric", "ratio") if k in kinds.values()],
    }
    for title, lines in sections.items():
        if lines:
            out += ["", f"═══ {title} ═══", *("  " + x for x in lines)]
    first = (df.orderBy(order) if order else df).select(*map(_col, names)).limit(sample).collect()
    return "\n".join([*out, "", f"═══ SAMPLE DATA (first {len(first)} rows) ═══", " | ".join(names), *(" | ".join(str(v)[:30] for v in r) for r in first)])
