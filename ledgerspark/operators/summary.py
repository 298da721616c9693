"""A dataset in one answer: its size, what its columns are, how good it is, its main figures and a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerspark.functions import formats
from ledgerspark.operators import profile, statement, structure


def summarized(df: DataFrame, order: str | None = None, sample: int = 3, question: str | None = None, most: int = 50) -> dict[str, object]:
    """rows, columns (what each is), quality, grade, figures (label and last value of a statement's metrics, if it's one and
    `order` names its rows' order), asked (the columns that a question is about) and sample. At most `most` columns are
    looked at; everything but the sample comes from aggregates."""
    names, rows = df.columns[:most], df.count()
    if not rows or not names:
        return {"rows": rows, "columns": {}, "quality": None, "grade": None, "figures": [], "asked": [], "sample": []}
    whole = profile.grade(profile.quality(df, names)).first()
    figures: list[tuple[str, float]] = []
    if order is not None:
        plan = structure.layout(df, order)
        if plan.label is not None:
            told = statement.overview(statement.long(df, plan.label, [c for c in names if c not in (plan.label, order)], order))
            figures = [(r.label, r.value) for r in told.collect()]
    first = (df.orderBy(order) if order else df).select(*(df[f"`{c}`"] for c in names)).limit(sample).collect()
    asked = formats.relevant_columns(question, names, 10) if question else []
    return {"rows": rows, "columns": profile.classified(df, names), "quality": whole.quality, "grade": whole.grade, "figures": figures, "asked": asked, "sample": [r.asDict() for r in first]}
