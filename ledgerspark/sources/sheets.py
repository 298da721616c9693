"""Sheets by their scores, and sheets that come as pandas frames."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning
from ledgerspark.operators import profile


def from_frames(spark: SparkSession, found: dict[str, pd.DataFrame]) -> dict[str, DataFrame]:
    """Sheets that a caller has in memory already; files are read by `workbook`."""
    out = {}
    for name, pdf in found.items():
        if len(pdf) >= 2:
            text = pdf.astype(object).where(pdf.notna(), None)
            rows = [[v if v is None or isinstance(v, (int, float, bool)) else str(v) for v in r] for r in text.itertuples(index=False)]
            kinds = ["double" if all(v is None or isinstance(v, (int, float)) for v in c) else "string" for c in zip(*rows, strict=True)]
            rows = [tuple(None if v is None else float(v) if k == "double" else str(v) for v, k in zip(r, kinds, strict=True)) for r in rows]
            schema = ", ".join(f"`c{i}` {k}" for i, k in enumerate(kinds))
            out[name] = cleaning.from_sheet(spark.createDataFrame(rows, schema).toDF(*map(str, pdf.columns)))
    return out


def scores(sheets: dict[str, DataFrame]) -> DataFrame:
    """sheet, score, best first."""
    each = [profile.scored_sheet(df).select(F.lit(name).alias("sheet"), "score") for name, df in sheets.items()]
    return reduce(DataFrame.union, each).orderBy(F.desc("score"), "sheet")


def best(sheets: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    name = scores(sheets).first().sheet
    return name, sheets[name]
