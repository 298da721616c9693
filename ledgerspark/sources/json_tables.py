"""JSON as tables: what shape a document has, and the tables in it. Shapes are read from Spark's schema, rows stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ledgerspark.functions import cleaning
from ledgerspark.functions.nested import flattened

DEPTH, DEEP = 10, 3  # fixed values: how deep tables are looked for; beyond which depth a document is complex


def parsed(spark: SparkSession, text: str) -> DataFrame:
    """One row with a column `doc`: the document, typed by its own schema."""
    schema = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    return spark.createDataFrame([(text,)], "text string").select(F.from_json("text", schema).alias("doc"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row with a column `doc` from a file with one document, as UTF-8 or else Latin-1."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return parsed(spark, raw.select(text).first()[0])


def _is_rows(kind: DataType) -> bool:
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)


def _deep(kind: DataType, depth: int = 0) -> bool:
    if depth > DEEP:
        return True
    if isinstance(kind, StructType):
        return any(_deep(f.dataType, depth + 1) for f in kind.fields)
    return _is_rows(kind) and _deep(kind.elementType, depth + 1)


def structure(kind: DataType) -> str:
    """records, columnar, nested_tables, single_record, complex_nested or unknown."""
    if isinstance(kind, ArrayType):
        return "records" if _is_rows(kind) else "unknown"
    if not isinstance(kind, StructType) or not kind.fields:
        return "unknown"
    kinds = [f.dataType for f in kind.fields]
    nested = any((isinstance(k, StructType) and k.fields) or _is_rows(k) for k in kinds)
    if nested and _deep(kind):
        return "complex_nested"
    if all(isinstance(k, ArrayType) for k in kinds):
        return "nested_tables" if _is_rows(kinds[0]) else "columnar"
    return "nested_tables" if any(isinstance(k, ArrayType) for k in kinds) else "single_record"


def _rows(doc: DataFrame, at, kind: DataType) -> DataFrame:
    """A list's elements as rows; structs as columns."""
    out = doc.select(F.explode(at).alias("value"))
    return out.select("value.*") if isinstance(kind.elementType, StructType) else out


def columnar(doc: DataFrame, at, kind: StructType) -> DataFrame:
    """A struct of lists as rows."""
    zipped = F.arrays_zip(*(at[f.name].alias(f.name) for f in kind.fields))
    return doc.select(F.explode(zipped).alias("r")).select("r.*").toDF(*kind.names)


def deep(doc: DataFrame, at, kind: DataType, path: str = "", depth: int = 0) -> list[tuple[str, DataFrame]]:
    """Every table inside: lists of records, and records' own values, named by their path."""
    if depth > DEPTH:
        return []
    if _is_rows(kind):
        return [(path or "root", flattened(_rows(doc, at, kind)))]
    if not isinstance(kind, StructType):
        return []
    out = []
    if any(not isinstance(f.dataType, (StructType, ArrayType)) for f in kind.fields):
        own = flattened(doc.select(at.alias("r")).select("r.*"))
        lists = {c for c in _paths(kind) if c in own.columns}
        out.append((path or "overview", own.drop(*lists)))
    for f in kind.fields:
        out += deep(doc, at[f.name], f.dataType, f"{path}_{f.name}" if path else f.name, depth + 1)
    return out


def _paths(kind: StructType, path: str = "") -> list[str]:
    """Names that lists of records have in a flattened row."""
    out = []
    for f in kind.fields:
        name = f"{path}_{f.name}" if path else f.name
        if _is_rows(f.dataType):
            out.append(name)
        elif isinstance(f.dataType, StructType):
            out += _paths(f.dataType, name)
    return out


def _table(df: DataFrame) -> DataFrame:
    """With plain names, complex values as JSON, and numbers where most values are."""
    names = cleaning.json_names(df.columns)
    plain = df.toDF(*names).select(*(F.to_json(f"`{n}`").alias(n) if isinstance(f.dataType, (StructType, ArrayType)) else F.col(f"`{n}`") for f, n in zip(df.schema.fields, names, strict=True)))
    return cleaning.coerced(plain)


def tables(doc: DataFrame, name: str) -> tuple[str, dict[str, DataFrame]]:
    """The document's shape and its tables by name; one table is called as the document, others by their keys too."""
    kind, at = doc.schema["doc"].dataType, F.col("doc")
    shape, base = structure(kind), name.lower().replace(" ", "_").replace("-", "_")
    if shape == "records":
        found = [(base, _rows(doc, at, kind))]
    elif shape == "columnar":
        found = [(base, columnar(doc, at, kind))]
    elif shape == "single_record":
        found = [(base, doc.select("doc.*"))]
    elif shape == "nested_tables":
        found = [(f.name, _rows(doc, at[f.name], f.dataType) if _is_rows(f.dataType) else _rows(doc, at[f.name], f.dataType).toDF(f.name)) for f in kind.fields if isinstance(f.dataType, ArrayType)]
    elif shape == "complex_nested":
        found = deep(doc, at, kind) or [("overview", flattened(doc.select("doc.*")))]
    else:
        raise ValueError("unknown or unsupported JSON structure")
    out = {}
    for key, df in found:
        key = "".join(c if c.isalnum() or c == "_" else "_" for c in key.lower().replace(" ", "_").replace("-", "_"))
        out[base if key == base else f"{base}:{key}"] = _table(df)
    return shape, out
