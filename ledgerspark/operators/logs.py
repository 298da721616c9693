"""Logs of interactions and metrics: tiers, what is kept, masked, archived and purged; counters, gauges, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of names of columns that hold personal data.
SENSITIVE = ["name", "email", "phone", "ssn", "pan", "aadhaar", "address", "dob", "date_of_birth"]
MASK, SHOWN = "<MASKED>", 500
#: How archived fields are called.
ARCHIVED = {"query_text": "user_query", "result": "final_response", "analysis_method": "method", "executed_code_hash": "code_hash"}
KEPT = ["log_id", "timestamp_utc", "client_id", "dataset_id", "provenance", "llm_provider", "llm_model", "latency_ms", "status", "error"]
#: Days that each tier is kept.
DAYS = {"high_value": 365, "medium_value": 30, "low_value": 1}


def _given(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def tier(log: DataFrame) -> DataFrame:
    """Adds `tier`, from query_text, result, provenance, status, method, latency_ms and, where there are such columns,
    executed_code_hash, analysis_method, tokens_used: what is worth keeping for learning, what only measures, and the rest."""
    col = lambda n: F.col(n) if n in log.columns else F.lit(None)
    whole = _given(col("query_text")) & col("result").isNotNull() & _given(col("provenance")) & (F.coalesce(col("status"), F.lit("")) == "success")
    run = _given(col("method")) | _given(col("analysis_method")) | _given(col("executed_code_hash"))
    measured = F.coalesce(col("latency_ms").cast("double") != 0, F.lit(False)) | F.coalesce(col("tokens_used").cast("double") != 0, F.lit(False))
    return log.withColumn("tier", F.when(whole | run, "high_value").when(measured, "medium_value").otherwise("low_value"))


def masked(df: DataFrame) -> DataFrame:
    """Columns whose names hold a word for personal data say so only; long texts are cut."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if any(s in n.lower() for s in SENSITIVE):
            c = F.lit(MASK)
        elif t == "string":
            c = F.when(F.length(c) > SHOWN, F.concat(F.substring(c, 1, SHOWN), F.lit("...<truncated>"))).otherwise(c)
        out.append(c.alias(n))
    return df.select(out)


def archive(log: DataFrame) -> DataFrame:
    """What is kept of entries of high value, under the archive's names, with year, month and day to partition by."""
    high = tier(log).where("tier = 'high_value'")
    at = F.col("timestamp_utc").cast("timestamp")
    fields = [F.col(c) for c in KEPT if c in log.columns] + [F.col(c).alias(a) for c, a in ARCHIVED.items() if c in log.columns]
    return high.select(*fields, F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"))


def written_archive(log: DataFrame, path: str) -> None:
    archive(log).write.mode("append").partitionBy("year", "month", "day").option("compression", "gzip").json(path)


def purged(log: DataFrame, now: Column) -> DataFrame:
    """The entries that their tier still keeps."""
    days = F.create_map(*(F.lit(x) for pair in DAYS.items() for x in pair))
    age = F.datediff(now, F.col("timestamp_utc").cast("timestamp"))
    return tier(log).where(age <= days[F.col("tier")]).drop("tier")


def provenance(dataset: Column, sheet: Column | None = None, row: Column | None = None, column: Column | None = None) -> Column:
    """struct that says where a value is from."""
    some = {"sheet": sheet, "row_index": row, "column": column}
    return F.struct(dataset.alias("dataset_id"), *(c.alias(n) for n, c in some.items() if c is not None))


def counters(events: DataFrame) -> DataFrame:
    """name, tags, total, from events of (name, tags, value)."""
    return events.groupBy("name", "tags").agg(F.sum("value").alias("total"))


def gauges(events: DataFrame) -> DataFrame:
    """name, tags, value: the last one by `at`."""
    return events.groupBy("name", "tags").agg(F.max_by("value", "at").alias("value"))


#: The shares of histograms' ranks.
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def histogram(events: DataFrame, key: str, value: str, bins: int = 256) -> DataFrame:
    """key, count, min, max, mean, p50, p95, p99: the value at place int(n * share) of all, sorted. Values are counted by
    bins of equal width first, so no task ranks more than a bin of a key."""
    rows = events.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null")
    stats = rows.groupBy("key").agg(F.count("*").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v").cast("decimal(38,6)")) / F.count("*")).cast("double").alias("mean"))
    width = F.when(F.col("max") > F.col("min"), (F.col("max") - F.col("min")) / bins).otherwise(F.lit(1.0))
    counted = rows.groupBy("key", "v").agg(F.count("*").alias("n")).join(stats, "key").withColumn("bin", F.least(F.floor((F.col("v") - F.col("min")) / width), F.lit(bins - 1)))
    by_bin = counted.groupBy("key", "bin").agg(F.sum("n").alias("n"))
    before = by_bin.select("key", "bin", (F.sum("n").over(Window.partitionBy("key").orderBy("bin")) - F.col("n")).alias("before"))
    ranked = counted.join(before, ["key", "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("key", "bin").orderBy("v")))
    at = lambda share: F.least(F.floor(F.col("count") * share), F.col("count") - 1)
    hit = lambda share: F.max(F.when((at(share) < F.col("upto")) & (at(share) >= F.col("upto") - F.col("n")), F.col("v")))
    found = ranked.groupBy("key").agg(*(hit(s).alias(p) for p, s in SHARES.items()))
    return stats.join(found, "key").select(F.col("key").alias(key), "count", "min", "max", F.round("mean", 4).alias("mean"), *SHARES)


def success_rates(attempts: DataFrame) -> DataFrame:
    """method, attempts, successes, success_rate, latency_ms (mean) of attempts to repair or to answer."""
    found = attempts.groupBy("method").agg(F.count("*").alias("attempts"), F.count_if(F.col("success")).alias("successes"), F.round(F.avg("latency_ms"), 4).alias("latency_ms"))
    return found.withColumn("success_rate", F.round(F.col("successes") / F.col("attempts"), 3))


def evict_score(accesses: Column, age: Column) -> Column:
    """What a cached entry is worth: its accesses over its age; the lowest goes first."""
    return accesses / (age + 1)


def by_priority(requests: DataFrame) -> DataFrame:
    """Requests in the order of their turn: priority, then time."""
    return requests.orderBy("priority", "at")
