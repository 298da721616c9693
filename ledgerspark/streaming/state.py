"""Streams that remember: budgets of tokens, states of jobs, requests that come twice; and files that arrive."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerspark.shipping import ship

LATE, REMEMBERED = "10 minutes", 3600  # rows that come later are dropped; seconds for which state is remembered
BUDGET = "client string, at timestamp, tokens double, allowed boolean, left double"


def spend(rows: pd.DataFrame, left: float, last: float | None, rate: float, capacity: float) -> tuple[list[bool], list[float], float, float | None]:
    """Which requests (at, tokens), in order, a bucket allows that refills by `rate` a second up to `capacity`."""
    allowed, lefts = [], []
    for at, tokens in zip(rows["at"], rows["tokens"], strict=True):
        now = at.timestamp()
        if last is not None:
            left = min(capacity, left + max(0.0, now - last) * rate)
        last = now if last is None else max(last, now)
        ok = left >= tokens
        left -= tokens if ok else 0.0
        allowed.append(ok)
        lefts.append(left)
    return allowed, lefts, left, last


def budgeted(requests: DataFrame, rate: float = 100.0, capacity: float = 1000.0) -> DataFrame:
    """Requests of (client, at, tokens) with whether each client's bucket allows them. On a stream the bucket is state,
    dropped after an hour of the stream's time; on a batch it's computed by client."""
    ship(requests.sparkSession)
    rows = requests.select("client", "at", F.col("tokens").cast("double").alias("tokens"))

    if not requests.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["at", "tokens"], kind="stable")
            allowed, lefts, _, _ = spend(pdf, capacity, None, rate, capacity)
            return pdf.assign(allowed=allowed, left=lefts)

        return rows.groupBy("client").applyInPandas(whole, BUDGET)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left, last = state.get if state.exists else (capacity, None)
        pdf = pd.concat(batches).sort_values(["at", "tokens"], kind="stable")
        allowed, lefts, left, last = spend(pdf, left, last, rate, capacity)
        state.update((left, last))
        state.setTimeoutTimestamp(int(max(1000 * last, state.getCurrentWatermarkMs())) + 1000 * REMEMBERED)
        yield pdf.assign(allowed=allowed, left=lefts)

    known = rows.withWatermark("at", LATE).groupBy("client")
    return known.applyInPandasWithState(step, BUDGET, "left double, last double", "append", GroupStateTimeout.EventTimeTimeout)


JOB = "task_id string, status string, started_at double, finished_at double, error string"
#: States that a job ends in.
ENDED = ("done", "error")


def merged(job: tuple | None, changes: pd.DataFrame) -> tuple:
    """A job (status, started_at, finished_at, error) after changes of (status, at, error) in order of time; one that has
    ended stays as it is until it's put again as pending."""
    status, started, finished, error = job or (None, None, None, None)
    for s, at, e in zip(changes["status"], changes["at"], changes["error"], strict=True):
        now = at.timestamp()
        if status in ENDED and s != "pending":
            continue
        if status is None or s == "pending":
            started, finished, error = now, None, None
        status = s
        if s in ENDED:
            finished, error = now, e
    return status, started, finished, error


def jobs(changes: DataFrame) -> DataFrame:
    """A job's state after each micro-batch of changes (task_id, status, at, error); jobs are forgotten after an hour of
    the stream's time without news. On a batch, the last state of each."""
    ship(changes.sparkSession)
    if not changes.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(pdf["task_id"].iloc[0], *merged(None, pdf.sort_values("at", kind="stable")))], columns=["task_id", "status", "started_at", "finished_at", "error"])

        return changes.groupBy("task_id").applyInPandas(whole, JOB)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        job = merged(state.get if state.exists else None, pd.concat(batches).sort_values("at", kind="stable"))
        state.update(job)
        state.setTimeoutTimestamp(int(max(1000 * (job[2] or job[1]), state.getCurrentWatermarkMs())) + 1000 * REMEMBERED)
        yield pd.DataFrame([(key[0], *job)], columns=["task_id", "status", "started_at", "finished_at", "error"])

    known = changes.withWatermark("at", LATE).groupBy("task_id")
    return known.applyInPandasWithState(step, JOB, "status string, started_at double, finished_at double, error string", "update", GroupStateTimeout.EventTimeTimeout)


def once(requests: DataFrame, key: str, at: str = "at", within: str = "10 minutes") -> DataFrame:
    """Each request once: on a stream as long as its watermark remembers it, on a batch the first by time."""
    if requests.isStreaming:
        return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
    first = requests.groupBy(key).agg(F.min_by(F.struct(*requests.columns), F.struct(at, *(c for c in requests.columns if c not in (at, key)))).alias("r"))
    return first.select("r.*").select(*requests.columns)


#: Bounds of tokens between buckets of requests that go together, and how many do.
SHORT, MEDIUM, TOGETHER = 100, 500, 8


def bucket(tokens: Column) -> Column:
    return F.when(tokens < SHORT, "short").when(tokens < MEDIUM, "medium").otherwise("long")


def batched(requests: DataFrame) -> DataFrame:
    """Requests with the group in which they go: of one bucket, by priority and time, eight at most. Places are counted within
    a priority's hour and added to the sizes of the hours before, so no task sorts a bucket."""
    rows = requests.withColumn("bucket", bucket(F.col("tokens"))).withColumn("__hour", F.date_trunc("hour", "at"))
    part = ["bucket", "priority", "__hour"]
    sizes = rows.groupBy(*part).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("bucket").orderBy("priority", "__hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(*(F.col(c).alias(f"__{c}") for c in part), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("at", "request_id"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in part]
    placed = rows.withColumn("__place", place).join(firsts, same[0] & same[1] & same[2])
    return placed.withColumn("batch", F.floor((F.col("__before") + F.col("__place") - 1) / TOGETHER).cast("int")).drop("__hour", "__place", "__before", *(f"__{c}" for c in part))


WITHIN = "client string, request_id string, at timestamp, n long"
MICROS = 1_000_000


def within(requests: DataFrame, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """client, request_id, at, n: how many requests of the client there were in the `seconds` up to each, itself and those of
    the same moment included. Rows without a client or a time are left out.

    On a stream a row comes out once the watermark has passed it, when none before it can come any more; state holds a client's rows that
    wait and the times of the last `seconds`, and a timer brings rows out, and takes state away, of clients from which nothing comes."""
    ship(requests.sparkSession)
    rows = requests.where("client is not null and at is not null").select(F.col("client").cast("string").alias("client"), F.col("request_id").cast("string").alias("request_id"), F.col("at").cast("timestamp").alias("at"))
    if not rows.isStreaming:
        micros = F.unix_micros("at")
        span = Window.partitionBy("client").orderBy(micros).rangeBetween(-seconds * MICROS, 0)
        return rows.withColumn("n", F.count("*").over(span))
    reach = seconds * MICROS

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, waiting, names = ([list(x) for x in state.get] if state.exists else ([], [], []))
        for pdf in [] if state.hasTimedOut else batches:
            waiting += [t.value // 1000 for t in pdf["at"]]
            names += list(pdf["request_id"])
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted(t for t in waiting if t <= passed)
        if ready:
            times = sorted(times + ready)
            out = [(key[0], name, pd.Timestamp(t, unit="us"), bisect_right(times, t) - bisect_left(times, t - reach)) for t, name in zip(waiting, names, strict=True) if t <= passed]
            yield pd.DataFrame(out, columns=["client", "request_id", "at", "n"])
        times = [t for t in times if t >= passed - reach]
        rest = [(t, name) for t, name in zip(waiting, names, strict=True) if t > passed]
        if not rest and not times:
            if state.exists:
                state.remove()
            return
        state.update((times, [t for t, _ in rest], [name for _, name in rest]))
        soonest = min(t for t, _ in rest) if rest else times[-1] + reach
        state.setTimeoutTimestamp(max(soonest // 1000, state.getCurrentWatermarkMs()) + 1)

    known = rows.withWatermark("at", late).groupBy("client")
    return known.applyInPandasWithState(step, WITHIN, "times array<long>, waiting array<long>, names array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def arriving(spark, folder: str, schema: str, handle: Callable[[DataFrame], None], checkpoint: str, kind: str = "csv") -> int:
    """Hands the files that have come to a folder since the last time to `handle`, each once, and ends; gives the number of
    rows handled."""
    stream = spark.readStream.schema(schema).format(kind).option("header", True).load(folder)
    seen = 0

    def each(df: DataFrame, _: int) -> None:
        nonlocal seen
        kept = df.persist()
        seen += kept.count()
        handle(kept)
        kept.unpersist()

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen


def events(df: DataFrame, size: int = 100) -> Iterator[dict]:
    """A result as a stream of messages: its columns, its rows in parts, how many there were; an error at the end if one
    comes up. Rows come partition by partition, not all at once."""
    try:
        yield {"event": "start", "columns": df.columns}
        part, n = [], 0
        for r in df.toLocalIterator():
            part.append(r.asDict())
            n += 1
            if len(part) == size:
                yield {"event": "rows", "rows": part}
                part = []
        if part:
            yield {"event": "rows", "rows": part}
        yield {"event": "done", "count": n}
    except Exception as e:  # noqa: BLE001  the stream's reader learns of it
        yield {"event": "error", "error": str(e)}
