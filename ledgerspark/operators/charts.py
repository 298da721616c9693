"""Charts in answers: found, checked, made plain."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ledgerspark.shipping import ship

#: Kinds of charts, and what each must have.
KINDS = {"line", "area", "bar", "scatter", "pie", "radar", "composed"}
REQUIRED = ["type", "title", "data"]
BLOCK = re.compile(r'```json\s*(\{[\s\S]*?"charts"[\s\S]*?\})\s*```', re.I)
BARE = re.compile(r'(\{[^{}]*"charts"\s*:\s*\[[^\]]+\][^{}]*\})')


def number(value: object) -> object:
    """Text that is a number as that number."""
    if not isinstance(value, str):
        return value
    try:
        return float(value) if "." in value else int(value)
    except ValueError:
        return value


def valid(chart: object) -> dict | None:
    """The chart as it's drawn, or nothing if something is missing."""
    if not isinstance(chart, dict) or any(f not in chart for f in REQUIRED):
        return None
    kind, data = str(chart["type"]).lower(), chart["data"]
    if kind not in KINDS or not isinstance(data, list) or not data:
        return None
    rows = [{k: number(v) for k, v in x.items()} for x in data if isinstance(x, dict)]
    out = {"type": kind, "title": str(chart["title"]), "data": rows, "xAxis": str(chart.get("xAxis", "")), "yAxis": str(chart.get("yAxis", ""))}
    return out | {"composed": chart["composed"]} if kind == "composed" and "composed" in chart else out


def _read(text: str) -> list[dict]:
    try:
        data = json.loads(re.sub(r",\s*([}\]])", r"\1", text.strip()))
    except json.JSONDecodeError:
        return []
    charts = data.get("charts") if isinstance(data, dict) else data
    return [c for c in map(valid, charts if isinstance(charts, list) else []) if c]


def extracted(answer: str) -> tuple[str, list[dict]]:
    """The answer without its blocks of charts, and the charts; those outside of blocks stay in the text."""
    charts, rest = [], answer
    blocks = BLOCK.findall(answer)
    for b in blocks:
        if got := _read(b):
            charts += got
            rest = re.sub(r"```json\s*" + re.escape(b) + r"\s*```", "", rest, flags=re.I)
    for b in BARE.findall(answer):
        if not any(b in x for x in blocks):
            charts += _read(b)
    return rest.strip(), charts


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("charts", StringType()), StructField("n", IntegerType())]))
def charts_udf(answers: pd.Series) -> pd.DataFrame:
    got = [extracted(a or "") for a in answers]
    return pd.DataFrame({"text": [g[0] for g in got], "charts": [json.dumps(g[1]) for g in got], "n": [len(g[1]) for g in got]})


def charts_in(answer: Column | str) -> Column:
    """struct<text, charts, n>: extracted() of a column; the charts as JSON."""
    ship(SparkSession.active())
    return charts_udf(answer)
