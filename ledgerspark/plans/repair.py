"""What language models write: SQL with wrong names, JSON that isn't, code inside prose; made usable."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerspark.shipping import ship

#: Names of columns that models make up.
MADE_UP = ["label", "metric", "column", "row", "value", "item", "name"]
#: What isn't JSON, and what it is there.
REPAIRS = [
    (r"\bTrue\b", "true"),
    (r"\bFalse\b", "false"),
    (r"\bNone\b", "null"),
    (r"(?<![a-zA-Z])'([^']*)'(?![a-zA-Z])", r'"\1"'),
    (r",\s*([\}\]])", r"\1"),
    (r"(\{|\,)\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*:", r'\1"\2":'),
    (r"\bNaN\b", "null"),
    (r"-?\bInfinity\b", "null"),
]
#: Prose that no SQL holds.
PROSE = ["I WOULD", "I THINK", "YOU SHOULD", "PLEASE NOTE", "HOWEVER", "UNFORTUNATELY", "THE QUERY", "THIS QUERY"]
FENCE = re.compile(r"```(?:json|python|sql)?\s*(.*?)\s*```", re.S | re.I)


def sql(text: str, columns: list[str], table: str | None = None) -> str:
    """SQL of a model with the columns' names as they are: `col.3` and `{col 3}` as col_3, numbers as the column at that
    place (from 0), made up names as the first column, names with signs quoted. Names are quoted by backticks."""
    low = {c.lower(): c for c in columns}
    by_number = lambda n: columns[int(n)] if int(n) < len(columns) else f"col_{n}"
    if table and table not in text:
        text = text.replace(table.replace("__", "_"), table)
    text = re.sub(r"\bcol\.(\d+)\b", r"col_\1", text, flags=re.I)
    text = re.sub(r"\{col\s*(\d+)\}", lambda m: f"`col_{m[1]}`", text)
    text = re.sub(r'"(\d+)"', lambda m: f"`{by_number(m[1])}`", text)
    text = re.sub(r"\b(SELECT|WHERE|AND|OR)\s+(\d+)(?=\s+(?:LIKE|FROM|AS|=|<|>|IS)\b|\s*[=<>,)])", lambda m: f"{m[1]} `{by_number(m[2])}`", text, flags=re.I)
    for name in MADE_UP:
        if name not in low and columns:
            text = re.sub(rf'"{name}"', f"`{columns[0]}`", text, flags=re.I)
    for c in sorted(columns, key=len, reverse=True):
        if re.search(r"[ \-.]", c):
            text = re.sub(rf"(?<![\w`\"']){re.escape(c)}(?![\w`\"'])", f"`{c}`", text)
    return re.sub(r'"([^"]+)"', lambda m: f"`{low.get(m[1].lower(), m[1])}`", text)


def _loaded(text: str) -> dict | None:
    try:
        out = json.loads(text)
    except ValueError:
        return None
    return out if isinstance(out, dict) else {"result": out} if isinstance(out, list) and out else {"value": out}


def _literal(text: str) -> dict | None:
    try:
        out = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _value(text: str) -> object:
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none"):
        return None
    try:
        return float(low) if "." in low else int(low)
    except ValueError:
        return text.strip()


def tolerant_json(text: str | None, otherwise: dict | None = None) -> dict:
    """What a text means as JSON: as it is; inside a fence; repaired; as a Python literal; the first object in it; its pairs
    of keys and values; at last `otherwise`, or a note that it's none."""
    if not text or not text.strip():
        return otherwise or {"error": "Empty content", "fallback": True}
    bare = m[1] if (m := FENCE.search(text)) else text.strip()
    fixed = bare
    for p, r in REPAIRS:
        fixed = re.sub(p, r, fixed)
    for read in (lambda: _loaded(text), lambda: _loaded(bare), lambda: _loaded(fixed), lambda: _literal(bare)):
        if (out := read()) is not None:
            return out
    for p in (r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", r"\{[^{}]+\}"):
        for part in re.findall(p, text):
            try:
                if isinstance(out := json.loads(part), dict):
                    return out
            except ValueError:
                continue
    pairs = re.findall(r'"?([a-zA-Z_][a-zA-Z0-9_]*)"?\s*:\s*"?([^",\n\}]+)"?', text)
    if pairs:
        return {k: _value(v) for k, v in pairs} | {"_extracted": True}
    return otherwise or {"error": "Invalid JSON", "raw_content": text[:500], "fallback": True}


@F.pandas_udf(StringType())
def tolerant_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(tolerant_json(t), ensure_ascii=False) for t in texts], dtype=object)


def tolerant_jsons(text: Column | str) -> Column:
    """tolerant_json() of a column, as JSON."""
    ship(SparkSession.active())
    return tolerant_udf(text)


def _is_sql(text: str) -> bool:
    up = text.upper()
    return len(text) >= 10 and "SELECT" in up and "FROM" in up and not any(p in up for p in PROSE)


def sql_in(text: str | None) -> str | None:
    """The SELECT statement in a text: in a fence, in quotes, or bare up to a semicolon or a blank line."""
    for p in (r"```sql\s*(SELECT.*?)```", r"```\s*(SELECT.*?)```", r"[\"'](SELECT\s+.*?)[\"']", r"\b(SELECT\b.+?\bFROM\b.+?)(?:;|\n\n|$)"):
        for m in re.finditer(p, text or "", re.S | re.I):
            if _is_sql(found := m[1].strip().rstrip(";").strip()):
                return found
    return None


def python_in(text: str | None) -> str | None:
    """The function run(df) in a text: in a fence, or as long as its lines are indented."""
    for p in (r"```(?:python)?\s*(def\s+run.*?)```", r"(def\s+run\s*\([^)]*\)\s*(?:->[^:]+)?:[^\n]*\n(?:[ \t]+[^\n]*(?:\n|$)|\s*\n)+)"):
        if (m := re.search(p, text or "", re.S | re.I if "```" in p else 0)) and "return" in m[1]:
            return m[1].strip()
    return None
