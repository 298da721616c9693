"""Tools by name over datasets, code of others, and the cascade of ways to answer a question."""

from __future__ import annotations

import builtins
import math
import random
import re
import statistics
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import formats, routing
from ledgerspark.functions.similarity import similarity_udf
from ledgerspark.operators import audit, structure
from ledgerspark.plans import guard, templates
from ledgerspark.shipping import ship


@dataclass
class Tool:
    name: str
    category: str
    run: Callable[..., dict]


@dataclass
class Result:
    """status: whether the tool ran; verdict: what it found."""

    tool: str
    status: str
    verdict: str | None
    output: dict
    explanation: str = ""


@dataclass
class Registry:
    """Tools by name. load gives the frame of a dataset's id."""

    load: Callable[[str], DataFrame]
    tools: dict[str, Tool] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        for name, run in (("benford_test", self.benford), ("cohort_analysis", self.cohort), ("three_way_match", self.match)):
            self.add(Tool(name, "analysis", run))

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def benford(self, dataset: str, column: str, threshold: float = audit.DEVIATION) -> dict:
        df = self.load(dataset)
        found = audit.column_like([c for c in df.columns if c == column] or df.columns, column)
        if found is None:
            return {"result": "error", "explain": f"Column not found: {column}"}
        row = audit.benford_verdict(df, found, threshold).first().asDict()
        return {"result": row["verdict"], "column": found, **row}

    def cohort(self, dataset: str, date_column: str, user_column: str, period: str = "month") -> dict:
        df = self.load(dataset)
        at, user = (audit.column_like([c for c in df.columns if c.lower() == x.lower()] or df.columns, x) for x in (date_column, user_column))
        if at is None or user is None:
            return {"result": "error", "explain": f"Column not found: {date_column if at is None else user_column}"}
        return {"result": "success", "frame": audit.retention(df, user, at, period)}

    def match(self, invoices: str, orders: str, ledger: str, tolerance: float = 0.01) -> dict:
        sides = (audit.side(self.load(d), name) for d, name in ((invoices, "invoice"), (orders, "po"), (ledger, "ledger")))
        frame = audit.three_way_match(*sides, tolerance, False)
        row = audit.match_verdict(frame).first().asDict()
        return {"result": row["verdict"], **row, "discrepancies": [r.asDict() for r in audit.discrepancies(frame).collect()]}

    def execute(self, name: str, **given) -> Result:
        if name not in self.tools:
            return Result(name, "error", None, {}, f"Tool '{name}' not found. Available: {sorted(self.tools)}")
        try:
            out = self.tools[name].run(**given)
        except Exception as e:  # noqa: BLE001  a tool's failure is its result
            out = {"result": "error", "explain": str(e)}
        status = "error" if out.get("result") == "error" else "success"
        self.history.append({"tool": name, "params": given, "success": status == "success", "category": self.tools[name].category})
        return Result(name, status, None if status == "error" else out.get("result"), out, out.get("explain", ""))

    def intended(self, question: str, specific_first: bool = True) -> str | None:
        """The tool that a question asks for, of those that are here."""
        rules = routing.TOOLS[4:] + routing.TOOLS[:4] if specific_first else routing.TOOLS
        return next((n for n, p in rules if n in self.tools and re.search(p, question.lower())), None)

    def respond(self, question: str, tool: str | None = None, **given) -> dict:
        name = tool or self.intended(question)
        if name is None:
            return {"success": False, "response": "I couldn't determine which tool to use for this query.", "suggestion": f"Available tools: {sorted(self.tools)}"}
        got = self.execute(name, **given)
        return {"success": got.status == "success", "verdict": got.verdict, "tool_output": got.output, "response": got.explanation or formats.tidy(f"{name}: {got.verdict}"), "tool_used": name}


#: What code of others may use.
BUILTINS = {f.__name__: f for f in (abs, all, any, bool, dict, enumerate, filter, float, int, len, list, map, max, min, range, round, set, sorted, str, sum, tuple, zip, isinstance)}
GIVEN = {"np": np, "pd": pd, "math": math, "statistics": statistics, "Decimal": Decimal, "F": F, "date": date, "datetime": datetime, "timedelta": timedelta}


def plain(value: object) -> object:
    """A result as JSON holds it."""
    if isinstance(value, DataFrame):
        return [r.asDict() for r in value.limit(1000).collect()]
    if isinstance(value, (pd.Series, np.ndarray)):
        return [plain(v) for v in value.tolist()]
    if isinstance(value, pd.DataFrame):
        return value.to_dict("records")
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def function(code: str, name: str = "run") -> Callable:
    """The function that checked code defines; imports of allowed modules are answered from what is given."""
    tree = guard.python(code)
    space = {"__builtins__": BUILTINS | {"__import__": lambda n, *a, **k: builtins.__import__(n, *a, **k) if n.split(".")[0] in guard.MODULES else _refuse(n)}, **GIVEN}
    builtins.exec(builtins.compile(tree, "<given>", "exec"), space)
    if not callable(space.get(name)):
        raise guard.Refused(f"no function {name}(df)")
    return space[name]


def _refuse(name: str):
    raise guard.Refused(f"may not import {name}")


def run_code(df: DataFrame, code: str) -> object:
    """What run(df) of others gives, df being the Spark frame: their plan runs on the cluster, not their rows here."""
    return plain(function(code)(df))


def run_code_by_group(df: DataFrame, code: str, schema: str, *keys: str) -> DataFrame:
    """run(frame) of others on each group as a pandas frame, in the executors."""
    guard.python(code)
    ship(df.sparkSession)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return function(code)(pdf)

    return df.groupBy(*keys).applyInPandas(apply, schema)


class Windows:
    """UDTF: the windows (start, end) of `size` that hold a place, one each `step`."""

    def eval(self, place: int, size: int, step: int):
        if place is None or not size or not step:
            return
        start = place - place % step
        while start > place - size:
            yield start, start + size
            start -= step


def register_functions(spark: SparkSession) -> None:
    """Functions of the engine for SQL: `windows_of(place, size, step)` as a table, `similarity(a, b)`, `mean_of_middle(x)`."""
    ship(spark)
    spark.udtf.register("windows_of", F.udtf(Windows, returnType="start: long, end: long"))
    spark.udf.register("similarity", similarity_udf)

    @F.pandas_udf("double")
    def mean_of_middle(x: pd.Series) -> float:
        lo, hi = x.quantile(0.1), x.quantile(0.9)
        some = x[(x >= lo) & (x <= hi)]
        return float(some.mean()) if len(some) else float("nan")

    spark.udf.register("mean_of_middle", mean_of_middle)


Way = Callable[[DataFrame, str], object]


def cascade(df: DataFrame, question: str, order: str, more: Iterable[tuple[str, Way]] = ()) -> tuple[object, str] | None:
    """The first answer that one of the ways has, and which: a template, a cell, a statement's arithmetic, then `more`, where
    a model's planner goes."""
    def by_template(df, q):
        got = templates.answered(df.drop(order), q)
        return guard.number(got[0]) if got else None

    ways = [("direct_lookup", lambda d, q: structure.direct_lookup({"data": d}, q, order)), ("statement", lambda d, q: structure.answered(d, q, order)), ("template", by_template), *more]
    for name, way in ways:
        if (got := way(df, question)) is not None:
            return got, name
    return None


def retried(call: Callable[[], object], times: int = 3, wait: float = 0.5, most: float = 30.0, errors: tuple = (OSError, TimeoutError), sleep=time.sleep) -> object:
    """What a call outside of Spark gives, tried again after growing, slightly random waits."""
    for n in range(times):
        try:
            return call()
        except errors:
            if n == times - 1:
                raise
            sleep(min(most, wait * 2**n) * (1 + random.random() / 10))
    raise AssertionError


class Providers:
    """Calls to the same service by several providers, tried in order; one that fails rests for a while. If all rest, the
    one that has rested longest is tried."""

    def __init__(self, calls: dict[str, Callable[..., object]], rest: float = 60.0, errors: tuple = (OSError, TimeoutError), clock=time.monotonic):
        self.calls, self.rest, self.errors, self.clock = calls, rest, errors, clock
        self.failed: dict[str, float] = {}

    def ready(self) -> list[str]:
        now = self.clock()
        able = [n for n in self.calls if now - self.failed.get(n, -self.rest) >= self.rest]
        return able or sorted(self.failed, key=self.failed.get)[:1]

    def __call__(self, *given: object) -> tuple[object, str]:
        """The answer, and whose it is; the last error if nobody has one."""
        error: BaseException | None = None
        for name in self.ready():
            try:
                answer = self.calls[name](*given)
            except self.errors as e:
                self.failed[name], error = self.clock(), e
            else:
                self.failed.pop(name, None)
                return answer, name
        raise error or LookupError("no providers")
