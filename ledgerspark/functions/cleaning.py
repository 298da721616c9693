"""Column expressions that clean names and values. All of them are built-in functions; none raises on dirty input."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

#: Strings that mean "no value", in any case of letters.
NO_VALUE = ["", "na", "n/a", "nan", "null", "none", "nil", "-", "--", "#n/a", "#ref!", "#value!", "na/p", "n.a."]
#: What spreadsheets write for no value, as they are.
NA_TOKENS = ["Na/p", "N/A", "n/a", "NA", "-", "--", "None", "none", "NULL", "null", "N.A.", "n.a."]
#: Fixed value: what a client's id may look like.
CLIENT = r"^[a-zA-Z0-9][a-zA-Z0-9_\-\.]{0,127}$"


def currency(c: Column) -> Column:
    """A number from text such as `$1,234.50`, `(12)` for -12, or `7 %` for 7; null for anything else."""
    bare = F.regexp_replace(F.btrim(c), r"[$€£₹,%\s]", "")
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.when(F.lower(F.btrim(c)).isin(NO_VALUE), None).otherwise(signed.try_cast("double"))


def without_tokens(c: Column) -> Column:
    """Null for the tokens that spreadsheets write for no value."""
    return F.when(~c.isin(NA_TOKENS), c)


def safe_name(c: Column) -> Column:
    """Lower case, runs of other characters than letters, digits and _ as one _, none at the ends, no leading digit."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(c)), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("col_"), s)).otherwise(s)


def sql_name(c: Column) -> Column:
    """A name as SQL columns have it: lower case, each other character than letters, digits and _ as _, col_ before a
    digit, `unnamed` for nothing."""
    s = F.regexp_replace(F.lower(F.btrim(c)), r"[^\p{L}\p{N}_]", "_")
    return F.when(s.rlike(r"^\p{Nd}"), F.concat(F.lit("col_"), s)).when(s == "", "unnamed").otherwise(s)


def sheet_name(c: Column) -> Column:
    """A name as columns of spreadsheets have it: other characters and white space as one _, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(c)), r"[^\p{L}\p{N}_\s]", "_"), r"\s+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def _once(names: list[str]) -> list[str]:
    seen, out = set(), []
    for n in names:
        new, i = n, 0
        while new.lower() in seen:
            i += 1
            new = f"{n}_{i}"
        seen.add(new.lower())
        out.append(new)
    return out


def sql_names(names: list[str]) -> list[str]:
    """sql_name() of all names; those that clash get numbers."""
    plain = lambda n: re.sub(r"[^\w]", "_", n.strip().lower()) or "unnamed"
    return _once([f"col_{p}" if (p := plain(n))[0].isdigit() else p for n in names])


def sheet_names(names: list[str]) -> list[str]:
    """sheet_name() of all names; those that clash get numbers."""
    spaced = (re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "_", n.strip().lower())) for n in names)
    return _once([re.sub("_+", "_", s).strip("_") or "unnamed" for s in spaced])


def json_names(names: list[str]) -> list[str]:
    """Names as columns of JSON tables have them: blanks and dashes as _, other characters dropped, letters as they are;
    col_ and the position for nothing and for a leading digit; clashes, without regard to case, get numbers."""
    out = []
    for i, n in enumerate(names):
        s = "".join(c for c in n.strip().replace(" ", "_").replace("-", "_") if c.isalnum() or c == "_")
        out.append(f"col_{i}" if not s or s[0].isdigit() else s)
    return _once(out)


def tenant(c: Column) -> Column:
    """A tenant's id: lower case, blanks, dashes, colons and slashes as one _, other characters than letters, digits, _ and
    . dropped, none of _ at the ends; `default_client` for nothing."""
    s = F.translate(F.btrim(F.lower(c)), " -:/\\", "_____")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9_.]", ""), "_+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "default_client").otherwise(s)


def tenant_of(name: str | None) -> str:
    """tenant() of one name."""
    s = (name or "").lower().strip().translate(str.maketrans(" -:/\\", "_____"))
    return re.sub("_+", "_", re.sub(r"[^a-z0-9_.]", "", s)).strip("_") or "default_client"


def client(c: Column) -> Column:
    """The id in lower case if it's a valid one, else `invalid`."""
    return F.when(F.btrim(c).rlike(CLIENT), F.lower(F.btrim(c))).otherwise("invalid")


def client_of(name: str | None) -> str:
    s = (name or "").strip()
    return s.lower() if re.match(CLIENT, s) else "invalid"


def id_part(c: Column) -> Column:
    """A string that is safe inside an id: lower case, blanks and dashes as one _, other characters dropped."""
    s = F.regexp_replace(F.translate(F.btrim(F.lower(c)), " -", "__"), r"[^a-zA-Z0-9_.]", "")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unnamed").otherwise(s)


def id_part_of(value: str | None) -> str:
    s = re.sub(r"[^a-zA-Z0-9_.]", "", (value or "").lower().strip().replace(" ", "_").replace("-", "_"))
    return re.sub("_+", "_", s).strip("_") or "unnamed"


def path_part(c: Column) -> Column:
    """A string that is safe as a folder's name."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(c)), r"[\\/:*?\"<>|]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")).isin("", ".", ".."), "unnamed").otherwise(s)


def path_part_of(value: str | None) -> str:
    s = re.sub("_+", "_", re.sub(r"[\\/:*?\"<>|]", "_", (value or "").lower().strip())).strip("_")
    return "unnamed" if s in ("", ".", "..") else s


def numeric_like(c: Column) -> Column:
    """Whether text is a number once thousands separators and signs of money and percent are gone."""
    bare = F.btrim(F.regexp_replace(c, r"[,%$₹]", ""))
    return F.coalesce(~F.lower(bare).isin("nan", "none", "-", "") & bare.try_cast("double").isNotNull(), F.lit(False))


def is_numeric_like(value: str) -> bool:
    bare = re.sub(r"[,%$₹]", "", value).strip()
    if bare.lower() in ("nan", "none", "-", ""):
        return False
    try:
        float(bare)
    except ValueError:
        return False
    return True


def _text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def _quoted(n: str) -> Column:
    return F.col("`" + n.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, least: float = 0.8) -> list[str]:
    """Text columns of whose non-null values more than `least` are numbers; one pass over the data."""
    text = _text_columns(df)
    if not text:
        return []
    row = df.agg(*(F.count(F.when(~F.lower(F.btrim(_quoted(n))).isin(NO_VALUE), 1)).alias(f"n{i}") for i, n in enumerate(text)), *(F.count(currency(_quoted(n))).alias(f"k{i}") for i, n in enumerate(text))).first()
    return [n for i, n in enumerate(text) if row[f"n{i}"] and row[f"k{i}"] > least * row[f"n{i}"]]


def cleaned(df: DataFrame) -> DataFrame:
    """Numbers where text columns hold numbers, `no value` as null elsewhere, safe names without clashes."""
    numbers, out = set(numeric_columns(df)), []
    names = [re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9_]+", "_", n.strip().lower())) or "col" for n in df.columns]
    names = _once([f"col_{n}" if n[0].isdigit() else n for n in names])
    for (n, t), name in zip(df.dtypes, names, strict=True):
        c = _quoted(n)
        c = currency(c) if n in numbers else F.when(~F.lower(F.btrim(c)).isin(NO_VALUE), c) if t == "string" else c
        out.append(c.alias(name))
    return df.select(out)


def registered(df: DataFrame) -> DataFrame:
    """As a table for SQL: SQL names, complex values as JSON, bytes as text, and text columns as numbers where all their
    values are numbers."""
    text = _text_columns(df)
    bare = lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(_quoted(n), r"[$,]", ""), r"^\((.*)\)$", "-$1"), "%", "").try_cast("double")
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(bare(n)).alias(f"k{i}") for i, n in enumerate(text)), *(F.count(_quoted(n)).alias(f"n{i}") for i, n in enumerate(text))).first()
    numbers = {n for i, n in enumerate(text) if row[f"k{i}"] and row[f"k{i}"] == row[f"n{i}"] == row["rows"]}
    out = []
    for field, name in zip(df.schema.fields, sql_names(df.columns), strict=True):
        c = _quoted(field.name)
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif isinstance(field.dataType, BinaryType):
            c = F.decode(c, "US-ASCII")
        elif field.name in numbers:
            c = bare(field.name)
        out.append(c.alias(name))
    return df.select(out)


def coerced(df: DataFrame, more_than: float = 0.5) -> DataFrame:
    """Text columns as numbers where more than a share of all rows are numbers; the others become null there."""
    text = _text_columns(df)
    if not text:
        return df
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(_quoted(n).try_cast("double")).alias(f"k{i}") for i, n in enumerate(text))).first()
    numbers = {n for i, n in enumerate(text) if row[f"k{i}"] > more_than * row["rows"]}
    return df.select(*((_quoted(n).try_cast("double") if n in numbers else _quoted(n)).alias(n) for n in df.columns))


def from_sheet(df: DataFrame, probe: int = 20) -> DataFrame:
    """As a table from a spreadsheet: no empty rows and columns, sheet names, tokens for no value as null, and text
    columns as numbers where the first `probe` values are numbers."""
    df = without_empty(df)
    df = df.toDF(*sheet_names(df.columns))
    out = []
    for n, t in df.dtypes:
        c = _quoted(n)
        if t == "string":
            c = without_tokens(c)
            bare = F.regexp_replace(F.regexp_replace(F.btrim(c), "[,%]", ""), r"^\(([\d.]+)\)$", "-$1")
            number = F.regexp_replace(F.regexp_replace(bare, r"^₹\s*", ""), r"^\$\s*", "").try_cast("double")
            first = df.select(c.alias("c"), number.alias("k")).where("c is not null").limit(probe).collect()
            if first and all(r.k is not None for r in first):
                c = number
        out.append(c.alias(n))
    return df.select(out)


def without_empty(df: DataFrame) -> DataFrame:
    """Without the rows and the columns that hold only nulls."""
    if not df.columns:
        return df
    counts = df.agg(*(F.count(_quoted(n)).alias(str(i)) for i, n in enumerate(df.columns))).first()
    kept = [n for i, n in enumerate(df.columns) if counts[i]]
    some = F.coalesce(*(_quoted(n).cast("string") for n in kept)).isNotNull() if len(kept) > 1 else _quoted(kept[0]).isNotNull() if kept else F.lit(False)
    return df.where(some).select(*(_quoted(n) for n in kept))


#: How dates are written, tried in this order.
DATES = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "MMM dd, yyyy"]


def moment(c: Column) -> Column:
    """A date from text in one of the usual spellings."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in DATES))


def instant(c: Column) -> Column:
    """A moment from text in one of the usual spellings, or from seconds (10 digits) or milliseconds (13) since 1970."""
    number = c.try_cast("long")
    unix = F.when(c.rlike(r"^\d{10}$"), F.timestamp_seconds(number)).when(c.rlike(r"^\d{13}$"), F.timestamp_millis(number))
    return F.coalesce(unix, moment(c))


def inferred(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Text columns as what they are, and what that is: number, integer, id, date, category or text.

    Over all rows, by column: more than 0.3 of the characters are digits, and once characters that come in more than a
    tenth of the values (signs of money, separators, units) are gone, more than 0.8 of the values are numbers; such a
    column is an id and stays text if its numbers are whole and nearly of one length, or nearly all different. Else it's a
    date if separators of dates are common and more than 0.8 of the values are dates; a category if few values recur."""
    text = _text_columns(df)
    kinds: dict[str, str] = {}
    if not text:
        return df, kinds
    at = {n: i for i, n in enumerate(text)}
    measures = []
    for n, i in at.items():
        c = _quoted(n)
        measures += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"u{i}"), F.sum(F.length(c)).alias(f"len{i}"), F.sum(F.length(F.regexp_replace(c, r"[^0-9]", ""))).alias(f"dig{i}"), F.sum(F.length(F.regexp_replace(c, r"[^/:\-]", ""))).alias(f"sep{i}"), F.count(moment(c)).alias(f"d{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *measures).first()
    numeric = [n for n, i in at.items() if row[f"n{i}"] and row[f"dig{i}"] > 0.3 * max(1, row[f"len{i}"])]
    noise: dict[str, str] = {n: "" for n in numeric}
    if numeric:
        chars = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("c"), _quoted(n).alias("v")) for n in numeric))).alias("x")).where("x.v is not null").select("x.c", F.explode(F.split("x.v", "")).alias("ch"))
        often = chars.where(~F.col("ch").rlike(r"[0-9.\-()]") & (F.col("ch") != "")).groupBy("c", "ch").agg(F.count(F.lit(1)).alias("k"))
        for r in often.collect():  # one row for each character of a column
            if r.k > 0.1 * row[f"n{at[r.c]}"]:
                noise[r.c] += r.ch

    def number(n: str) -> Column:
        bare = F.translate(_quoted(n), noise[n], "") if noise[n] else _quoted(n)
        return F.regexp_replace(bare, r"^\(([\d\.]+)\)$", "-$1").try_cast("double")

    if numeric:
        more = df.agg(*(m for n in numeric for i in [at[n]] for m in (F.count(number(n)).alias(f"k{i}"), F.count_if(number(n) % 1 != 0).alias(f"f{i}"), F.count_distinct(F.length(_quoted(n))).alias(f"l{i}"), F.avg(F.length(_quoted(n))).alias(f"m{i}"), F.approx_count_distinct(number(n)).alias(f"q{i}")))).first()
    for n, i in at.items():
        some = row[f"n{i}"]
        if not some:
            kinds[n] = "text"
        elif n in numeric and more[f"k{i}"] > 0.8 * some:
            whole = not more[f"f{i}"]
            if whole and ((more[f"l{i}"] <= 2 and more[f"m{i}"] > 3) or more[f"q{i}"] > 0.9 * more[f"k{i}"]):
                kinds[n] = "id"
            else:
                kinds[n] = "integer" if whole else "number"
        elif row[f"sep{i}"] > 0.5 * some and row[f"d{i}"] > 0.8 * some:
            kinds[n] = "date"
        else:
            kinds[n] = "category" if row[f"u{i}"] < 0.2 * row["rows"] and some > 20 else "text"
    made = {"number": number, "integer": lambda n: number(n).cast("long"), "date": lambda n: moment(_quoted(n))}
    return df.select(*(made[kinds[n]](n).alias(n) if kinds.get(n) in made else _quoted(n).alias(n) for n in df.columns)), kinds
