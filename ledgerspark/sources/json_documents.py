"""Many JSON documents at once as tables: parsed where they are read, into VARIANT, and taken apart by rows.

Documents may differ: each has a shape of its own (as in `json_tables.structure`), and rows of the same table in different
documents come together. What a table holds is told by one schema over all its rows; only schemas and names of tables
reach the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerspark.functions.nested import flattened
from ledgerspark.sources.json_tables import DEEP, DEPTH, _paths, _table

OBJECT, ROWS, LIST = "OBJECT<%", "ARRAY<OBJECT<%", "ARRAY<%"


def read(spark: SparkSession, path: str) -> DataFrame:
    """id (the file's path), text of all files at path, as UTF-8 or else Latin-1."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), "content")
    return raw.select("id", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("text"))


def parsed(texts: DataFrame) -> DataFrame:
    """id, doc (VARIANT; null where the text isn't JSON) from id, text."""
    return texts.select("id", F.try_parse_json("text").alias("doc"))


def _kind(value: str) -> str:
    return f"schema_of_variant({value})"


def _children(nodes: DataFrame) -> DataFrame:
    """id, key, value of the fields of objects, and id, null, value of the records in lists of records."""
    inside = nodes.where(f"{_kind('value')} like '{OBJECT}' or {_kind('value')} like '{ROWS}'")
    found = inside.lateralJoin(inside.sparkSession.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("k"), F.col("value").alias("v")))
    return found.select("id", F.col("k").alias("key"), F.col("v").alias("value"))


def _inside(value: Column) -> Column:
    """The values one level down in one value: an object's fields, the records of a list of them."""
    kind = F.schema_of_variant(value)
    return F.when(kind.like(OBJECT), F.map_values(value.cast("map<string, variant>"))).when(kind.like(ROWS), value.cast("array<variant>")).otherwise(F.array().cast("array<variant>"))


def shapes(docs: DataFrame) -> DataFrame:
    """id, doc, shape: records, columnar, nested_tables, single_record, complex_nested or unknown. Each shape is told from the
    document alone; nothing is shuffled, and ids may repeat."""
    level = F.array("doc")
    for _ in range(DEEP + 1):
        level = F.flatten(F.transform(level, _inside))
    fields = f"transform(map_entries(case when k like '{OBJECT}' then cast(doc as map<string, variant>) end), e -> named_struct('key', e.key, 'k', {_kind('e.value')}))"
    told = docs.select("id", "doc").withColumn("k", F.expr(_kind("doc"))).withColumn("f", F.expr(fields))
    told = told.withColumn("nested", F.expr(f"exists(f, x -> (x.k like '{OBJECT}' and x.k <> 'OBJECT<>') or x.k like '{ROWS}')"))
    told = told.withColumn("deep", F.when(F.col("nested"), F.size(level) > 0))
    shape = f"""case when doc is null then 'unknown' when k like '{ROWS}' then 'records' when k not like '{OBJECT}' or size(f) = 0 then 'unknown'
        when deep then 'complex_nested' when forall(f, x -> x.k like '{LIST}') then if(array_min(f).k like '{ROWS}', 'nested_tables', 'columnar')
        when exists(f, x -> x.k like '{LIST}') then 'nested_tables' else 'single_record' end"""
    # through a generator, below which no filter on the shape is moved: it would parse the text again for each mention
    return told.select("id", F.struct("doc", F.expr(shape).alias("shape")).alias("s")).select("id", F.inline(F.array("s")))


def rows(shaped: DataFrame) -> DataFrame:
    """id, table, value (VARIANT): every row of every table of the documents. The table of a document that is one table is ''."""
    of = lambda shape: shaped.where(F.col("shape") == shape).select("id", F.col("doc").alias("value"))
    plain = of("single_record").select("id", F.lit("").alias("table"), "value")
    records = _children(of("records")).select("id", F.lit("").alias("table"), "value")
    spark = shaped.sparkSession
    fields = _children(of("columnar"))
    cells = fields.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select("pos", F.col("value").alias("v")))
    columnar = cells.groupBy("id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("m")).select("id", F.lit("").alias("table"), F.parse_json(F.to_json("m")).alias("value"))
    lists = _children(of("nested_tables")).where(f"{_kind('value')} like '{LIST}'").withColumn("records", F.expr(f"{_kind('value')} like '{ROWS}'"))
    inside = lists.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("value").alias("v")))
    nested = inside.select("id", F.col("key").alias("table"), F.when(F.col("records"), F.col("v")).otherwise(F.parse_json(F.to_json(F.create_map("key", "v")))).alias("value"))
    found = [plain, records, columnar, nested]
    level = of("complex_nested").withColumn("table", F.lit(""))
    for _ in range(DEPTH + 1):
        level = level.withColumn("k", F.expr(_kind("value"))).persist()  # read by four plans
        if not level.limit(1).count():  # all parts at once
            break
        found.append(level.where(f"k like '{ROWS}'").lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("value").alias("v"))).select("id", F.when(F.col("table") == "", "root").otherwise(F.col("table")).alias("table"), F.col("v").alias("value")))
        objects = level.where(f"k like '{OBJECT}'").lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("f"), F.col("value").alias("v"))).where("f is not null")
        scalar = F.expr(f"not ({_kind('v')} like '{OBJECT}' or {_kind('v')} like '{LIST}')")
        own = objects.where(scalar).select("id", "table").distinct()
        found.append(level.where(f"k like '{OBJECT}'").join(own, ["id", "table"], "left_semi").select("id", F.when(F.col("table") == "", "overview").otherwise(F.col("table")).alias("table"), "value"))
        level = objects.select("id", F.col("v").alias("value"), F.concat_ws("_", F.nullif("table", F.lit("")), "f").alias("table"))
    return reduce(DataFrame.unionByName, found)


def ddl(schema: str) -> str:
    """A VARIANT's schema as a type: objects as structs, decimals as doubles, what is always null or mixed as text."""
    return re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", re.sub(r"\bOBJECT<", "STRUCT<", schema)).replace("VOID", "STRING").replace("VARIANT", "STRING")


def typed(table: DataFrame, flat: bool = False) -> DataFrame:
    """id and the columns of one table's rows, by the schema of all of them, with plain names. Objects and lists are JSON text;
    flat: objects are columns, and lists of records are left out, as they are tables of their own."""
    schema = ddl(table.agg(F.schema_of_variant_agg("value")).first()[0] or "VOID")
    if not schema.startswith("STRUCT<") or schema == "STRUCT<>":
        return table.select("id", F.col("value").cast("string").alias("value"))
    # by way of JSON text, so that a value of another type than most becomes text or null, not an error
    wide = table.select(F.col("id").alias("__id"), F.from_json(F.to_json("value"), schema).alias("r")).select("__id", "r.*")
    if flat:
        wide = flattened(wide).drop(*_paths(StructType([f for f in wide.schema.fields if f.name != "__id"])))
    plain = _table(wide)
    return plain.withColumnRenamed(plain.columns[0], "id")


def tables(texts: DataFrame) -> dict[str, DataFrame]:
    """All tables of the documents (id, text) by name, '' for documents that are one table, each with the id of its document.
    Those of deeply nested documents are flat; `_nested` follows their names where others have the same."""
    shaped = shapes(parsed(texts)).persist()
    out = {}
    for nested in (False, True):
        every = rows(shaped.where((F.col("shape") == "complex_nested") == F.lit(nested))).persist()
        for r in every.select("table").distinct().orderBy("table").collect():  # names of tables
            name = f"{r.table}_nested" if r.table in out else r.table
            out[name] = typed(every.where(F.col("table") == r.table).select("id", "value"), nested)
    return out
