"""SQL, paths, code and names from outside: what may pass. One read-only statement over known tables, parsed by Catalyst;
column names repaired."""

from __future__ import annotations

import ast
import os
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ledgerspark.functions.cleaning import client_of

#: Statements that may run, and what none may hold.
ALLOWED = re.compile(r"^\s*(SELECT|WITH|EXPLAIN)\b", re.I)
FORBIDDEN = [
    re.compile(r"\b(DROP|ALTER|TRUNCATE|DELETE|INSERT|UPDATE|CREATE|REPLACE|GRANT|REVOKE)\b\s", re.I),
    re.compile(r";\s*(DROP|ALTER|TRUNCATE|DELETE|INSERT|UPDATE|CREATE)", re.I),
    re.compile(r"--\s*.*$", re.M),
    re.compile(r"/\*.*?\*/", re.S),
    re.compile(r"\bEXEC(UTE)?\b", re.I),
    re.compile(r"\bxp_\w+", re.I),
    re.compile(r"\bSYSTEM\b\s*\(", re.I),
    re.compile(r"\bLOAD_FILE\b", re.I),
    re.compile(r"\bINTO\s+OUTFILE\b", re.I),
    re.compile(r"\bINTO\s+DUMPFILE\b", re.I),
    re.compile(r"\bUNION\b.*\bSELECT\b.*\bFROM\b.*\binformation_schema\b", re.I | re.S),
]
#: What no path may hold.
PATHS = [re.compile(r"\.\.[\\//]"), re.compile(r"[\\//]\.\."), re.compile(r"^~"), re.compile(r"[\x00-\x1f]"), re.compile(r'[<>"|?*]')]
#: What no code may hold, the modules it may import, and the calls it may not make.
CODE = [
    re.compile(r"\b(os\.(system|exec|popen|remove|rmdir|unlink|rename))\b"),
    re.compile(r"\b(subprocess|shutil)\.\w+"),
    re.compile(r"\b(eval|exec|compile)\s*\("),
    re.compile(r"\b(__import__|importlib)\b"),
    re.compile(r"\bopen\s*\(.*[\"']w[\"']"),
    re.compile(r"\b(requests|urllib|socket|http)\.\w+"),
    re.compile(r"\b(pickle|marshal|shelve)\.(load|loads)\b"),
    re.compile(r"\bglobals\s*\(\s*\)"),
    re.compile(r"\b__builtins__\b"),
]
MODULES = {"pandas", "numpy", "math", "decimal", "statistics", "datetime"}
CALLS = {"eval", "exec", "compile", "open", "__import__", "input", "breakpoint", "globals", "locals", "vars", "dir", "getattr", "setattr", "delattr"}
HIDDEN = {"__class__", "__subclasses__", "__mro__", "__bases__", "__builtins__", "__globals__", "__import__"}


class Refused(ValueError):
    """It isn't allowed; the message says why."""


def _outside_of_text(sql: str) -> str:
    return re.sub(r"'(?:[^']|'')*'", "''", sql)


def sanitized(sql: str) -> str:
    """The statement without a closing semicolon, if its words may run; what's inside quotes doesn't count."""
    sql = (sql or "").strip()
    if not sql:
        raise Refused("empty SQL")
    if not ALLOWED.match(sql):
        raise Refused(f"only SELECT, WITH and EXPLAIN, not {sql.split()[0]}")
    bare = _outside_of_text(sql)
    for p in FORBIDDEN:
        if m := p.search(bare):
            raise Refused(f"a dangerous pattern: {m[0].strip()}")
    sql = sql.rstrip(";").strip()
    if ";" in _outside_of_text(sql):
        raise Refused("more than one statement")
    return sql


#: Catalyst's nodes of a statement that only reads; all others (commands, scripts, names made by expressions) are
#: refused, and so are the functions that call Java, and functions of tables but these.
READING = {
    "Project", "Filter", "UnresolvedHaving", "Aggregate", "Distinct", "Deduplicate", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Tail",
    "Join", "LateralJoin", "AsOfJoin", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "WithWindowDefinition",
    "Generate", "Expand", "Pivot", "Unpivot", "UnpivotTransformer", "Sample", "UnresolvedHint", "View", "ResolvedInlineTable", "UnresolvedInlineTable",
    "OneRowRelation", "OneRowRelation$", "LocalRelation", "UnresolvedRelation", "UnresolvedTableValuedFunction", "RelationTimeTravel", "UnresolvedTVFAliases",
}
CALLING = {"reflect", "java_method", "try_reflect"}
OF_TABLES = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}


def check(spark: SparkSession, sql: str, tables: set[str]) -> str:
    """The statement, if it may run. tables: the relations that it may read, names of one or more parts; files are none of
    them. A name of one part is a common table expression where one of that name is in scope: behind it in the same WITH,
    in that WITH's statement and in what is nested in these, and in its own definition only if that is a recursive union. It
    never stands for a name of more parts."""
    sql = sanitized(sql)
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(re.sub(r"^\s*explain\s+((extended|codegen|cost|formatted)\s+)?", "", sql, flags=re.I))
        known = {_folded(spark, _each(parser.parseMultipartIdentifier(t))) for t in tables}
    except ParseException as e:
        raise Refused(f"not SQL: {e.getCondition()}") from e
    read: set[tuple[str, ...]] = set()
    _walk(spark, plan, frozenset(), read)
    if unknown := read - known:
        raise Refused(f"unknown tables: {', '.join(sorted('.'.join(t) for t in unknown))}")
    return sql


def relations(spark: SparkSession, sql: str) -> set[tuple[str, ...]]:
    """The relations that a statement reads, as parts of names, without its common table expressions."""
    read: set[tuple[str, ...]] = set()
    _walk(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(), read)
    return read


def _each(seq) -> list:
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _folded(spark: SparkSession, parts: list[str]) -> tuple[str, ...]:
    """Names as the session compares them."""
    return tuple(parts) if spark.conf.get("spark.sql.caseSensitive") == "true" else tuple(p.lower() for p in parts)


def _walk(spark: SparkSession, node, scope: frozenset[str], read: set[tuple[str, ...]]) -> None:
    """Adds what a parsed plan reads. scope: the common table expressions that are visible at this node."""
    kind = node.getClass().getSimpleName()
    if kind not in READING:
        raise Refused(f"not a statement that only reads: {kind}")
    for e in _each(node.expressions()):
        _expression(e)
    if kind == "UnresolvedRelation":
        parts = _folded(spark, _each(node.multipartIdentifier()))
        if len(parts) > 1 or parts[0] not in scope:
            read.add(parts)
    elif kind == "RelationTimeTravel":
        _walk(spark, node.relation(), frozenset(), read)
    elif kind == "UnresolvedTableValuedFunction" and ".".join(_each(node.name())).lower() not in OF_TABLES:
        raise Refused(f"a function of tables: {'.'.join(_each(node.name()))}")
    elif kind == "UnresolvedWith":
        for pair in _each(node.cteRelations()):
            name, made = _folded(spark, [str(pair.productElement(0))])[0], pair.productElement(1)
            _walk(spark, made, scope | {name} if node.allowRecursion() and _is_union(made) else scope, read)
            scope |= {name}
    for inner in [*_each(node.children()), *_each(node.subqueries())]:
        _walk(spark, inner, scope, read)


def _is_union(node) -> bool:
    """Whether a definition adds rows to a first step, as recursion does."""
    while node.getClass().getSimpleName() in ("SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "Union"


def _expression(e) -> None:
    """Refuses functions that call Java, and generators that aren't known, in an expression."""
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and _each(e.nameParts())[-1].lower() in CALLING:
        raise Refused(f"a function that calls Java: {_each(e.nameParts())[-1]}")
    if kind == "UnresolvedGenerator" and e.name().funcName().lower() not in OF_TABLES:
        raise Refused(f"a function of tables: {e.name().funcName()}")
    for inner in _each(e.children()):
        _expression(inner)


def run(spark: SparkSession, sql: str, tables: set[str], retries: int = 3) -> DataFrame:
    """The checked statement's result; an unknown column is replaced by one of Catalyst's proposals, up to `retries` times:
    `col_` and the name, else one that holds it, else the first."""
    sql = check(spark, sql, tables)
    for left in range(retries, -1, -1):
        try:
            df = spark.sql(sql)
            df.schema  # noqa: B018  analysis
            return df
        except AnalysisException as e:
            found = e.getMessageParameters() or {}
            name = found.get("objectName", "").strip("`").split("`.`")[-1]
            offered = [p.split(".")[-1].strip("`") for p in found.get("proposal", "").split(", ") if p]
            if not left or e.getCondition() != "UNRESOLVED_COLUMN.WITH_SUGGESTION" or not offered:
                raise
            best = next((p for p in offered if p == f"col_{name}"), None) or next((p for p in offered if name.lower() in p.lower()), offered[0])
            quoted = "`" + best.replace("`", "``") + "`"
            sql = check(spark, re.sub(rf"(?<!\w)`?{re.escape(name)}`?(?!\w)", lambda _, q=quoted: q, sql), tables)
    raise AssertionError


def scalar(df: DataFrame) -> object:
    """The first column of the first row; None if there is no row."""
    row = df.limit(1).first()
    return row[0] if row else None


def number(df: DataFrame) -> object:
    """A result of one row and one column as a float, if it's a number; any other as it is."""
    value = scalar(df) if len(df.columns) == 1 and df.limit(2).count() == 1 else None
    try:
        return float(value) if value is not None else df
    except (TypeError, ValueError):
        return value


def path(given: str, bases: list[str] | None = None) -> str:
    """The path, resolved, if it stays where it may."""
    if not given or not given.strip():
        raise Refused("empty path")
    if any(p.search(given) for p in PATHS):
        raise Refused(f"not a path inside: {given}")
    real = os.path.realpath(os.path.abspath(given))
    inside = lambda b: os.path.commonpath([real, os.path.realpath(b)]) == os.path.realpath(b)
    if bases and not any(map(inside, bases)):
        raise Refused("outside of the folders that are allowed")
    return real


def client(name: str) -> str:
    """The client's id in lower case."""
    found = client_of(name)
    if found == "invalid":
        raise Refused(f"not a client's id: {name!r}")
    return found


def python(code: str, modules: set[str] = MODULES) -> ast.Module:
    """The code, parsed, if it imports, calls and names only what it may."""
    if not code or not code.strip():
        raise Refused("empty code")
    for p in CODE:
        if m := p.search(code):
            raise Refused(f"an unsafe pattern: {m[0]}")
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        raise Refused(f"not Python: {e}") from e
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        if bad := [n for n in names if n.split(".")[0] not in modules]:
            raise Refused(f"may not import {bad[0]}")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in CALLS:
            raise Refused(f"may not call {node.func.id}")
        if (isinstance(node, ast.Attribute) and node.attr in HIDDEN) or (isinstance(node, ast.Name) and node.id in HIDDEN):
            raise Refused("may not look behind objects")
    return tree
