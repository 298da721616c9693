"""Rules that tell what a question needs, as column expressions over a column of questions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import periods
from ledgerspark.functions.similarity import expanded, groups

#: The patterns of each track, in order; the first that is found anywhere, in any case of letters, wins.
#: Data and document tracks need data; without any they are passed over.
TRACKS = [
    ("TRACK_DATA", [
        r"\b(calculate|compute|sum|total|average|mean|count|aggregate)\b.*\b(revenue|profit|cost|margin|expense|growth|ebitda|sales|income|debt|equity|wacc|fcf|roi|irr|npv)\b",
        r"\b(revenue|profit|cost|margin|expense|growth|ebitda|sales|income|debt|equity)\b.*\b(for|in|of|during)\b.*\b(fy|q[1-4]|\d{4}|year|quarter|month|period)\b",
        r"\b(compare|difference|change|variance|delta)\b.*\b(q[1-4]|fy\d{2,4}|\d{4})\b",
        r"\b(what|how much|how many|show|get|find|give)\b.*\b(total|revenue|profit|cost|margin|expense|growth|value|amount|number|count|percentage|ratio)\b",
        r"\b(yoy|qoq|year.over.year|quarter.over.quarter|ytd|mtd)\b.*\b(growth|change|increase|decrease|trend)\b",
        r"\b(highest|lowest|maximum|minimum|top|bottom|rank|sort)\b.*\b(revenue|profit|cost|margin|expense|sales|income|value)\b",
        r"\b(filter|where|when|which)\b.*\b(greater|less|more|above|below|between|equal)\b",
        r"\b(how many|count|number of)\b.*\b(sheets?|columns?|rows?|records?|entries|items)\b",
        r"\b(what|list|show)\b.*\b(columns?|fields?|sheet\s*names?|headers?)\b",
        r"\b(is there|does it|find|search|look for|any mention)\b.*\b(company|name|entity|mention|reference)\b",
    ]),
    ("TRACK_DOC_SUMMARY", [
        r"^(give|show|provide|tell)\s+(me\s+)?(a\s+|the\s+)?(summary|overview|description)\b",
        r"^(summarize|describe|explain)\s+(this|the|our|my)?\s*(data|file|dataset|spreadsheet|excel|report)\b",
        r"^what\s+(is|does)\s+(this|the)\s+(data|file|dataset|spreadsheet)\s+(about|contain)\b",
        r"^tell\s+me\s+about\s+(this|the|our|my)\s+(data|file|dataset|spreadsheet|report)\b",
    ]),
    ("TRACK_DOC", [
        r"\b(clause|section|article|paragraph|provision|subsection)\s+\d+",
        r"\b(contract|agreement|policy|regulation|compliance|terms|conditions|audit|legal|governance)\b.*\b(says?|states?|requires?|specifies?|defines?)\b",
        r"\b(accounting|disclosure|regulatory|risk|governance)\s+(policy|policies|standard|requirement|guideline)\b",
    ]),
    ("TRACK_WEB", [
        r"\b(current|today|live|real.time|latest|breaking|this week)\s*(repo rate|gst|tax rate|market|stock|price|news|inflation|gdp|forex|gold|oil|currency|cryptocurrency)\b",
        r"\btoday'?s\s+(market|stock|gold|oil|forex|commodity|news|price)\b",
        r"\b(rbi|sebi|budget)\s+(circular|regulation|announcement|update|notification)\s*\d{4}\b",
    ]),
    ("TRACK_OUT_OF_DOMAIN", [
        r"^(tell me a joke|write (a )?poem|recipe for|how to (play|cook|make)|write (a )?story)\b",
    ]),
]
NEEDS_DATA = {"TRACK_DATA", "TRACK_DOC"}
CONFIDENCE = 0.95

#: Words that speak for an intent, anywhere in the question.
INTENTS = [
    ("CALCULATION", ["calculate", "compute", "sum", "total", "average", "mean", "count", "percentage", "growth", "rate", "ratio", "margin", "variance"]),
    ("ENTITY_SEARCH", ["is there any mention", "any mention of", "does it mention", "does this mention", "is there a reference", "find mentions", "is there any company", "company name", "are there any", "does it contain", "does this contain", "check if there is", "search for", "look for", "find in", "extract"]),
    ("DATA_QUERY", ["show me", "list", "filter", "get the value", "find the row", "what are the", "how many", "which", "where is"]),
    ("SUMMARY", ["summary", "summarize", "overview", "describe", "explain", "about", "tell me about", "what is this", "what does this"]),
    ("DOCUMENT_SEARCH", ["clause", "policy", "contract", "agreement", "regulation", "compliance", "legal", "audit requirement", "document section"]),
    ("REAL_TIME", ["current", "today", "now", "live", "real-time", "latest", "recent", "this week", "breaking", "news", "market quote"]),
    ("OUT_OF_DOMAIN", ["joke", "poem", "recipe", "cook", "game", "story", "fiction", "medical advice", "vacation", "movie", "music"]),
]

#: What asks for a tool, in order; the first that is found wins.
TOOLS = [
    ("web_search", "(search|find|look up|what is|current|latest)"),
    ("search_tax_rate", "(tax rate|gst rate|tds rate|income tax)"),
    ("search_regulation", "(regulation|compliance|rule|law|requirement)"),
    ("search_benchmark", "(benchmark|industry average|market rate|standard)"),
    ("benford_test", "(benford|fraud|anomaly|first digit|suspicious)"),
    ("cohort_analysis", "(cohort|retention|customer lifetime|churn)"),
    ("three_way_match", "(reconcil|3-way|three-way|match|invoice.*po|po.*invoice)"),
]

#: Words that ask for a chart, hints of its kind in order, and words that suggest one.
CHART_WORDS = ["chart", "graph", "plot", "visualize", "visualization", "show me a", "draw", "display chart", "create chart"]
CHART_HINTS = [
    ("line", ["line chart", "line graph", "trend", "over time", "timeline"]),
    ("bar", ["bar chart", "bar graph", "comparison", "compare", "breakdown by"]),
    ("pie", ["pie chart", "pie graph", "breakdown", "distribution", "share", "proportion"]),
    ("area", ["area chart", "cumulative", "stacked area", "filled"]),
    ("scatter", ["scatter", "correlation", "relationship between", "x vs y"]),
    ("radar", ["radar", "spider", "multi-dimensional", "multi-metric"]),
    ("composed", ["combined", "dual axis", "bar and line", "mixed chart"]),
]
SUGGESTING = ["trend", "growth", "yoy", "cagr", "comparison"]
SUGGEST_LINE = ["year on year", "year over year", "y-o-y", "quarter on quarter", "quarter over quarter", "q-o-q", "month on month", "month over month", "m-o-m", "compound annual growth rate", "compound growth", "over the years", "across periods", "time series", "historical", "trajectory", "progression"]
SUGGEST_BAR = ["by category", "by segment", "by product", "vs", "versus", "compared to", "relative to"]
SUGGEST_PIE = ["breakdown", "share of", "portion of", "percentage breakdown", "distribution of", "split between", "composition"]

#: Words of live and of past matters, of summaries, of one's own data.
REAL_TIME = ["current", "today", "now", "live", "real-time", "latest", "recent", "this week", "this month", "breaking", "new", "update", "announcement", "quote", "index", "news", "forecast"]
HISTORICAL = ["historical", "past", "year ago", "last year", "previous", "old", "archive", "backtesting", "analysis", "trend", "5 years", "10 years", "last 5 years", "last 10 years"]
SUMMARY = ["summary", "summarize", "overview", "describe", "explain", "tell me about"]
OWN_DATA = ["our data", "your data", "my data", "the data", "dataset", "uploaded", "loaded", "file"]

#: Operations by the words that ask for them, in order.
OPERATIONS = [
    ("sum", ["sum", "total", "add"]),
    ("average", ["average", "mean", "avg"]),
    ("growth", ["growth", "change", "difference", "variance"]),
    ("compare", ["compare", "versus", "vs"]),
    ("list", ["list", "show", "display"]),
]

#: Kinds of question, for answers to empty results, in order.
QUESTION_KINDS = [
    ("existence", ["is there", "any mention", "any reference", "utterance", "does it have"]),
    ("count", ["how many", "count of", "number of", "total count", "count"]),
    ("search", ["find", "search", "look for", "looking for", "where is"]),
    ("comparison", ["compare", "difference", "vs", "versus"]),
    ("value", ["what is", "what's", "show me", "give me", "total", "sum", "average"]),
    ("percentage", ["growth", "increase", "decrease", "%", "percent", "margin", "ratio"]),
    ("list", ["list", "top", "bottom", "all", "names", "items"]),
]

#: Metrics by category.
METRICS = {
    "revenue": [r"revenue", r"sales", r"income", r"turnover", r"receipts", r"top\s*line", r"gross\s*receipts", r"net\s*sales"],
    "expense": [r"expense", r"cost", r"expenditure", r"outflow", r"spend", r"operating\s*expense", r"overhead", r"opex", r"capex"],
    "profit": [r"profit", r"margin", r"earning", r"ebitda", r"ebit", r"net\s*income", r"gross\s*profit", r"operating\s*profit", r"pbt", r"pat", r"bottom\s*line", r"p&l", r"p_l", r"pnl", r"profit\s*(?:and|&)\s*loss"],
    "asset": [r"asset", r"receivable", r"inventory", r"cash", r"investment", r"property", r"equipment", r"intangible", r"goodwill"],
    "liability": [r"liability", r"payable", r"debt", r"loan", r"borrowing", r"obligation", r"provision", r"accrual"],
    "equity": [r"equity", r"capital", r"reserve", r"surplus", r"retained", r"share\s*capital", r"stock"],
    "cashflow": [r"cash\s*flow", r"operating\s*cash", r"free\s*cash", r"financing", r"investing", r"working\s*capital"],
    "ratio": [r"ratio", r"percentage", r"percent", r"growth", r"change", r"variance", r"margin\s*%", r"yield", r"return"],
    "volume": [r"volume", r"quantity", r"units", r"orders", r"transactions", r"customers", r"users", r"subscribers", r"count"],
    "performance": [r"gmv", r"arpu", r"aov", r"ltv", r"cac", r"arr", r"mrr", r"dau", r"mau", r"conversion", r"churn", r"retention"],
}

#: What a question intends, for lookups.
LOOKUPS = {
    "aggregation": [r"\btotal\b", r"\bsum\b", r"\baggregate\b", r"\bcumulative\b", r"\bentire\b", r"\ball\b", r"\bwhole\b"],
    "comparison": [r"\bgrowth\b", r"\bchange\b", r"\bvariance\b", r"\bdifference\b", r"\bvs\b", r"\bversus\b", r"\bcompare\b", r"\bfrom\b.*\bto\b"],
    "lookup": [r"\bwhat\s+(is|was|were)\b", r"\bfind\b", r"\blook\s*up\b", r"\bget\b", r"\bshow\b", r"\bvalue\s*(of|for)\b"],
    "percentage": [r"\bpercentage\b", r"\bpercent\b", r"\b%\b", r"\bratio\b", r"\bproportion\b"],
}


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def holds(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of the words, as a substring."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _holds_sql(words: list[str], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def first_of(pairs: list[tuple[str, Column]], otherwise: str | None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, condition in pairs:
        out = out.when(condition, name)
    return out.otherwise(F.lit(otherwise).cast("string"))


def track(text: Column, data_loaded: bool = True) -> Column:
    """The track of the first pattern found; null where no pattern is."""
    text = F.coalesce(text, F.lit(""))
    return first_of([(n, reduce(lambda a, b: a | b, (text.rlike("(?i)" + p) for p in ps))) for n, ps in TRACKS if data_loaded or n not in NEEDS_DATA], None)


SQL = "SELECT conv_id, turn, CASE " + " ".join("WHEN " + " OR ".join("regexp_matches(coalesce(text, ''), '(?i)" + p.replace("'", "''").replace(".*", "[^\\n]*").replace("year.over", "year[^\\n]over") + "')" for p in ps) + f" THEN '{n}'" for n, ps in TRACKS) + " END AS track FROM {t}"


def intent(text: Column) -> Column:
    """The intent with most of its words in the text, the first of equals; null unless it has two or is the only one."""
    low = _low(text)
    counted = F.array(*(F.struct(reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in ws)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(INTENTS)))
    best = F.array_max(counted)
    some = F.size(F.filter(counted, lambda c: c["n"] > 0))
    return F.when((best["n"] >= 2) | (some == 1), best["name"])


INTENT_SQL = "WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM {t}), n AS (SELECT *, [" + ", ".join("{'n': " + " + ".join(f"contains(t, '{w}')::INT" for w in ws) + f", 'i': {-i}, 'name': '{name}'}}" for i, (name, ws) in enumerate(INTENTS)) + "] AS c FROM q) SELECT conv_id, turn, CASE WHEN list_max(c).n >= 2 OR len(list_filter(c, lambda x: x.n > 0)) = 1 THEN list_max(c).name END AS intent FROM n"


def tool(text: Column, specific_first: bool = False) -> Column:
    """The tool that a question asks for; null for none. Searches, whose words are common, come first, unless
    specific_first puts the analyses before them."""
    low = F.lower(text)
    rules = TOOLS[4:] + TOOLS[:4] if specific_first else TOOLS
    return first_of([(n, low.rlike(p)) for n, p in rules], None)


TOOL_SQL = "SELECT conv_id, turn, CASE " + " ".join("WHEN regexp_matches(lower(text), '" + p.replace(".*", "[^\\n]*") + f"') THEN '{n}'" for n, p in TOOLS) + " END AS tool FROM {t}"


def _suggesting() -> tuple[list[str], list[str], list[str]]:
    words = {*SUGGESTING}.union(*(groups().get(w, ()) for w in SUGGESTING))
    return SUGGEST_PIE, SUGGEST_BAR, sorted(words.difference(SUGGEST_PIE, SUGGEST_BAR).union(SUGGEST_LINE))


def chart(text: Column) -> Column:
    """struct<wants, kind>: whether a chart is wanted and of which kind. Hints of a kind come first; a suggestion gives pie
    before bar before line where several are in the text."""
    low = _low(text)
    asked = holds(low, CHART_WORDS)
    pie, bar, line = (holds(low, words) for words in _suggesting())
    hinted = first_of([(k, holds(low, ws)) for k, ws in CHART_HINTS], None)
    suggested = F.when(~asked, first_of([("pie", pie), ("bar", bar), ("line", line)], None))
    return F.struct((asked | pie | bar | line).alias("wants"), F.coalesce(hinted, suggested).alias("kind"))


CHART_SQL = "WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM {t}) SELECT conv_id, turn, " + _holds_sql(CHART_WORDS + sum(map(list, _suggesting()), [])) + " AS wants, coalesce(CASE " + " ".join(f"WHEN {_holds_sql(ws)} THEN '{k}'" for k, ws in CHART_HINTS) + f" END, CASE WHEN {_holds_sql(CHART_WORDS)} THEN NULL " + " ".join(f"WHEN {_holds_sql(list(ws))} THEN '{k}'" for k, ws in zip(("pie", "bar", "line"), _suggesting(), strict=True)) + " END) AS kind FROM q"


def real_time(text: Column) -> Column:
    """Whether a question is about live matters."""
    low = _low(text)
    current, today = low.contains("current"), low.contains("today")
    told = holds(low, ["show", "give", "tell", "get"]) & ~current & ~today & ~low.contains("latest")
    barred = holds(low, HISTORICAL) | holds(low, SUMMARY) | (holds(low, OWN_DATA) & ~current & ~today) | told
    return ~barred & holds(low, REAL_TIME)


REAL_TIME_SQL = f"WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM {{t}}) SELECT conv_id, turn, NOT ({_holds_sql(HISTORICAL)} OR {_holds_sql(SUMMARY)} OR ({_holds_sql(OWN_DATA)} AND NOT {_holds_sql(['current', 'today'])}) OR ({_holds_sql(['show', 'give', 'tell', 'get'])} AND NOT {_holds_sql(['current', 'today', 'latest'])})) AND {_holds_sql(REAL_TIME)} AS real_time FROM q"


def operation(text: Column) -> Column:
    low = _low(text)
    return first_of([(n, holds(low, ws)) for n, ws in OPERATIONS], "lookup")


OPERATION_SQL = "WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM {t}) SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_holds_sql(ws)} THEN '{n}'" for n, ws in OPERATIONS) + " ELSE 'lookup' END AS operation FROM q"


def question_kind(text: Column) -> Column:
    low = _low(text)
    return first_of([(n, holds(low, ws)) for n, ws in QUESTION_KINDS], "general")


KIND_SQL = "WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM {t}) SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_holds_sql(ws)} THEN '{n}'" for n, ws in QUESTION_KINDS) + " ELSE 'general' END AS kind FROM q"


def _metric(patterns: list[str]) -> str:
    return "(?i)" + "|".join(rf"\b{p}\b" for p in patterns)


def metric_categories(text: Column) -> Column:
    """The categories of metrics that a text names, in their order."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*(F.when(text.rlike(_metric(ps)), n) for n, ps in METRICS.items())), lambda x: x.isNotNull())


METRIC_SQL = "SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{_metric(ps)}') THEN '{n}' END" for n, ps in METRICS.items()) + "], lambda x: x IS NOT NULL) AS metrics FROM {t}"


def metrics_in(text: str) -> list[tuple[str, str]]:
    """(text, category) of the metrics in a text."""
    return [(m[0], n) for n, ps in METRICS.items() for p in ps for m in re.finditer(rf"\b{p}\b", text, re.I)]


def parsed(question: str) -> dict:
    """A question's intents, periods, metrics, keywords, and the strategy by which to look its answer up."""
    found = periods.found(question)
    out = {
        "original": question,
        "intent": [n for n, ps in LOOKUPS.items() if any(re.search(p, question, re.I) for p in ps)],
        "periods": [{"text": t, "normalized": n, "type": k} for t, n, k in found],
        "metrics": [{"text": t, "category": c} for t, c in metrics_in(question)],
        "keywords": expanded(question),
    }
    return out | {"strategy": strategy(out)}


def strategy(q: dict) -> dict:
    """What to search for: rows, columns, a computation; and how sure that is. The first rule that applies decides."""
    intents, times, metrics = q["intent"], bool(q["periods"]), bool(q["metrics"])
    plan = lambda kind, row=False, column=False, compute=False, llm=False, sure=0.5: {"lookup_type": kind, "requires_row_search": row, "requires_column_search": column, "requires_computation": compute, "llm_required": llm, "confidence": sure}
    if any(w in q["original"].lower() for w in SUMMARY):
        return plan("summary", llm=True, sure=0.9)
    if "aggregation" in intents:
        return plan("aggregation", metrics, times, True, sure=0.8)
    if "comparison" in intents or len(q["periods"]) >= 2:
        return plan("comparison", True, True, True, len(q["periods"]) < 2, 0.85)
    if times and (metrics or q["keywords"] & {"revenue", "sales", "profit", "cost", "expense", "gmv", "income"}):
        return plan("cell", True, True, sure=0.9)
    if len(q["periods"]) == 1 and not metrics:
        return plan("column", column=True, sure=0.7)
    if metrics and not times:
        return plan("row", True, sure=0.7)
    if "percentage" in intents:
        return plan("cell", True, times, sure=0.75)
    if "lookup" in intents:
        return plan("cell", True, times, llm=True, sure=0.6)
    return plan("cell", llm=True, sure=0.3)


def routing_rates(log: DataFrame) -> DataFrame:
    """method, n, share of all routed questions, mean confidence: which tier decided."""
    found = log.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return found.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
