"""Nested rows as flat ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

SHOWN = 10  # fixed value: so many scalars of a list are shown


def _flat(c: Column, kind: DataType, name: str) -> list[Column]:
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _flat(c[f.name], f.dataType, f"{name}_{f.name}" if name else f.name)]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return [F.concat(F.lit("["), F.size(c).cast("string"), F.lit(" records]")).alias(name)]
    if isinstance(kind, ArrayType):
        return [F.array_join(F.transform(F.slice(c, 1, SHOWN), lambda x: x.cast("string")), ", ").alias(name)]
    return [c.alias(name)]


def flattened(df: DataFrame) -> DataFrame:
    """Structs become columns named by their path with _, lists of structs `[n records]`, other lists their first items."""
    return df.select([x for f in df.schema.fields for x in _flat(F.col(f"`{f.name}`"), f.dataType, f.name)])


def merged(first: Column, second: Column) -> Column:
    """One map of two; where both have a key, the second's value."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def holds(column: str, pairs: dict[str, str]) -> Column:
    """Whether a map has all of the pairs."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(column)[k] == v, F.lit(False)) for k, v in pairs.items()), F.lit(True))
