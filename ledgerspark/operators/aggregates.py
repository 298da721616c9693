"""Aggregates of one's own in two phases: states made where rows are read, merged by group.

Spark's own grouped Python functions see a whole group in one frame. Here a task turns each Arrow batch into one state for
each group that the batch has, and merges a group's states as they come; only states, of bounded size, are shuffled. A group
may hold a third of all rows: it's one state a task. For SQL the two phases are functions of tables: see `register`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerspark.shipping import ship

#: Groups whose states a task holds before it sends them on.
HELD = 1 << 16


@dataclass(frozen=True)
class Aggregate:
    """partial: values (no nulls) to a state, an array of doubles of one length; merge: two states to one; finish: a state to a
    number. merge must not mind the order."""

    partial: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float | None]


def _moments(x: np.ndarray) -> np.ndarray:
    mean = x.mean()
    d = x - mean
    return np.array([len(x), mean, (d**2).sum(), (d**3).sum(), (d**4).sum()])


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of powers of distances from the mean, of both sides, from those of each."""
    (n, p, a2, a3, a4), (m, q, b2, b3, b4) = a, b
    k, d = n + m, q - p
    two = a2 + b2 + d * d * n * m / k
    three = a3 + b3 + d**3 * n * m * (n - m) / k**2 + 3 * d * (n * b2 - m * a2) / k
    four = a4 + b4 + d**4 * n * m * (n * n - n * m + m * m) / k**3 + 6 * d * d * (n * n * b2 + m * m * a2) / k**2 + 4 * d * (n * b3 - m * a3) / k
    return np.array([k, p + d * m / k, two, three, four])


def _excess(s: np.ndarray) -> float | None:
    return float(s[0] * s[4] / s[2] ** 2 - 3) if s[2] > 0 else None


def _geometric(x: np.ndarray) -> np.ndarray:
    above = x[x > 0]
    return np.array([len(above), np.log(above).sum()])


#: Aggregates by name: excess kurtosis, and the geometric mean of what is above zero.
KNOWN = {
    "kurtosis_of": Aggregate(_moments, _together, _excess),
    "geometric_mean": Aggregate(_geometric, lambda a, b: a + b, lambda s: float(np.exp(s[1] / s[0])) if s[0] else None),
}


def aggregated(df: DataFrame, group: str, value: str, of: Aggregate, to: str = "value") -> DataFrame:
    """group, to: the aggregate of a column by another one, null keys being a group. Nulls and NaN don't count; a group without
    values has null."""
    ship(df.sparkSession)
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray | None] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            values = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            sound = ~np.isnan(values)
            order = np.argsort(codes[sound], kind="stable")
            mine, values = codes[sound][order], values[sound][order]
            for name in names:
                held.setdefault(name, None)
            cuts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else []
            for a, b in zip(cuts, [*cuts[1:], len(mine)], strict=True):
                state, name = of.partial(values[a:b]), names[mine[a]]
                held[name] = state if held[name] is None else of.merge(held[name], state)
            if len(held) > HELD:
                yield states(held)
                held = {}
        if held:
            yield states(held)

    def states(held: dict[object, np.ndarray | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), key), pa.array([None if s is None else np.asarray(s, "<f8").tobytes() for s in held.values()], pa.binary())], ["g", "s"])

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States of a group lie together; one at a time is merged."""
        now, state, any_ = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any_ and name != now:
                    out.append((now, None if state is None else of.finish(state)))
                    state = None
                now, any_ = name, True
                if blob is not None:
                    one = np.frombuffer(blob, "<f8")
                    state = one if state is None else of.merge(state, one)
            if out:
                yield done(out)
        if any_:
            yield done([(now, None if state is None else of.finish(state))])

    def done(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], key), pa.array([o[1] for o in out], pa.float64())], [group, to])

    key = to_arrow_type(df.schema[group].dataType)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = rows.mapInArrow(first, f"g {kind}, s binary")
    return partial.repartition(n, "g").sortWithinPartitions("g").mapInArrow(last, f"`{group}` {kind}, `{to}` double")


def _functions(of: Aggregate):
    """The two phases as classes for functions of tables."""

    class States:
        def __init__(self) -> None:
            self.held: dict[str | None, np.ndarray | None] = {}
            self.values: dict[str | None, list[float]] = {}

        def eval(self, row):
            name, value = row[0], row[1]
            mine = self.values.setdefault(name, [])
            if value is not None and value == value:
                mine.append(float(value))
                if len(mine) >= 1024:
                    self._taken(name)

        def _taken(self, name) -> None:
            if mine := self.values.get(name):
                state = of.partial(np.array(mine))
                self.held[name] = state if self.held.get(name) is None else of.merge(self.held[name], state)
                self.values[name] = []

        def terminate(self):
            for name in list(self.values):
                self._taken(name)
                state = self.held.get(name)
                yield name, None if state is None else np.asarray(state, "<f8").tobytes()

    class Merged:
        def __init__(self) -> None:
            self.name, self.state, self.any = None, None, False

        def eval(self, row):
            self.name, self.any = row[0], True
            if row[1] is not None:
                one = np.frombuffer(bytes(row[1]), "<f8")
                self.state = one if self.state is None else of.merge(self.state, one)

        def terminate(self):
            if self.any:
                yield self.name, None if self.state is None else of.finish(self.state)

    return States, Merged


def register(spark: SparkSession, name: str, of: Aggregate | None = None) -> None:
    """For SQL: `<name>_states(TABLE(t))` gives a state of each group and task of a table of two columns, the group as text and
    the value; `<name>(TABLE(states) PARTITION BY g)` merges them."""
    ship(spark)
    states, merged = _functions(of or KNOWN[name])
    spark.udtf.register(f"{name}_states", F.udtf(states, returnType="g: string, s: binary"))
    spark.udtf.register(name, F.udtf(merged, returnType="g: string, value: double"))
