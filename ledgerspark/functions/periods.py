"""Periods in texts and in column names: fiscal years, quarters, halves, months, dates, years."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: What a period in a text looks like, in any case of letters, and its kind.
PATTERNS = [
    (r"\b(fy\s*\'?\d{2,4})\b", "fiscal_year"),
    (r"\b(fiscal\s+year\s+\d{4})\b", "fiscal_year"),
    (r"\b(f[yq]\d{2,4})\b", "fiscal_year"),
    (r"\b(\d{1,2}m\s*fy\s*\'?\d{2,4})\b", "partial_year"),
    (r"\b(ytd\s*fy\s*\'?\d{2,4})\b", "partial_year"),
    (r"\b(h[12]\s*fy\s*\'?\d{2,4})\b", "half_year"),
    (r"\b(q[1-4]\s*\'?\d{2,4})\b", "quarter"),
    (r"\b(q[1-4]\s*fy\s*\'?\d{2,4})\b", "quarter"),
    (r"\b(quarter\s+[1-4])\b", "quarter"),
    (r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)[\s\-\']*(\d{2,4})?\b", "month"),
    (r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b", "date"),
    (r"\b(\d{2}[-/]\d{2}[-/]\d{4})\b", "date"),
    (r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b", "date"),
    (r"\b(20\d{2}|19\d{2})\b", "year"),
    (r"\b(cy\s*\d{2,4})\b", "calendar_year"),
]

#: What a whole column name looks like that is a period, and its kind.
COLUMN_PATTERNS = [
    (r"^fy\d{2}$", "fiscal_year"),
    (r"^\d{1,2}mfy\d{2}$", "period_fy"),
    (r"^q\d[_-]?fy\d{2}$", "quarter"),
    (r"^q\d[_-]?\d{2}$", "quarter"),
    (r"^h\d[_-]?fy\d{2}$", "half_year"),
    (r"^\d{4}$", "year"),
    (r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[_-]?\d{2,4}$", "month_year"),
]

#: The shorter list by which templates find periods in a question.
TEMPLATE_PATTERNS = [r"fy\d{2}", r"\d{1,2}mfy\d{2}", r"q\d(?:fy\d{2})?", r"(january|february|march|april|may|june|july|august|september|october|november|december)\s*\d{2,4}"]


def normalized(text: str) -> str:
    """One spelling for a period: lower case without blanks, quotes and dashes; a date becomes its month and year."""
    low = re.sub(r"['\s\-]+", "", text.lower().strip()).replace("fiscalyear", "fy")
    day = re.match(r"(\d{4})-(\d{2})-(\d{2})", text)
    return f"{MONTHS[int(day[2]) - 1]}_{day[1]}" if day and 1 <= int(day[2]) <= 12 else low


def found(text: str) -> list[tuple[str, str, str]]:
    """(text, normalized, kind) of every period in the text, by pattern."""
    return [(m[0], normalized(m[0]), kind) for p, kind in PATTERNS for m in re.finditer(p, str(text), re.I)]


def _normalized(c: Column) -> Column:
    low = F.replace(F.regexp_replace(F.lower(F.btrim(c)), r"['\s\-]+", ""), F.lit("fiscalyear"), F.lit("fy"))
    month = F.regexp_extract(c, r"^(\d{4})-(\d{2})-(\d{2})", 2).try_cast("int")
    day = c.rlike(r"^\d{4}-\d{2}-\d{2}") & month.between(1, 12)
    return F.when(day, F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(month, F.lit(1))), F.lit("_"), F.substring(c, 1, 4))).otherwise(low)


def periods(text: Column) -> Column:
    """array<struct<text, normalized, kind>> of the periods in a text column, by pattern, as found() has them."""
    text = F.coalesce(text, F.lit(""))
    one = lambda p, kind: F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), lambda m: F.struct(m.alias("text"), _normalized(m).alias("normalized"), F.lit(kind).alias("kind")))
    return F.flatten(F.array(*(one(p, kind) for p, kind in PATTERNS)))


def periods_sql(text: str) -> str:
    """DuckDB: `kind:normalized` of the periods in an expression."""
    low = "replace(regexp_replace(lower(trim(m)), '[''\\s\\-]+', '', 'g'), 'fiscalyear', 'fy')"
    months = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
    name = f"CASE WHEN regexp_matches(m, '^\\d{{4}}-(0[1-9]|1[0-2])-\\d{{2}}') THEN {months}[CAST(substr(m, 6, 2) AS INT)] || '_' || substr(m, 1, 4) ELSE {low} END"
    one = lambda p, kind: f"list_transform(regexp_extract_all({text}, '(?i){p.replace(chr(39), chr(39) * 2)}', 0), lambda m: '{kind}:' || {name})"
    return "flatten([" + ", ".join(one(p, kind) for p, kind in PATTERNS) + "])"


def column_kind(name: str) -> str | None:
    """What kind of period a column's name is."""
    low = name.lower().strip()
    return next((kind for p, kind in COLUMN_PATTERNS if re.match(p, low)), None)


def in_question(question: str) -> list[str]:
    """The periods that templates see. A month comes back without its year."""
    return [m[1] if m.re.groups else m[0] for p in TEMPLATE_PATTERNS for m in re.finditer(p, question.lower())]


#: Two-digit years up to this one are of this century.
PIVOT = 50


def month_column(question: str, columns: list[str]) -> str | None:
    """The column that a question's month and year name, in any usual spelling: `January 2023` finds `jan_23`, `Jan-2023`."""
    asked = re.search(r"\b(" + "|".join(MONTHS) + r")[a-z]*[\s\-_']*(\d{4}|\d{2})\b", question.lower())
    if not asked:
        return None
    full = lambda y: int(y) if len(y) == 4 else int(y) + (2000 if int(y) <= PIVOT else 1900)
    for c in columns:
        m = re.search(r"(" + "|".join(MONTHS) + r")[a-z]*[\s\-_']*(\d{4}|\d{2})(?!\d)", c.lower())
        if m and m[1] == asked[1] and full(m[2]) == full(asked[2]):
            return c
        d = re.match(r"(\d{4})-(\d{2})-\d{2}", c)
        if d and MONTHS[int(d[2]) - 1 if 1 <= int(d[2]) <= 12 else 0] == asked[1] and int(d[1]) == full(asked[2]):
            return c
    return None


def excel_date(serial: Column) -> Column:
    """The date of a spreadsheet's serial number; null outside of 1 to 2958465 (31 December 9999)."""
    n = serial.try_cast("int")
    return F.when(n.between(1, 2958465), F.date_add(F.lit(date(1899, 12, 30)), n))


def excel_date_of(serial: float) -> date | None:
    return date(1899, 12, 30) + timedelta(days=int(serial)) if 1 <= serial < 2958466 else None
