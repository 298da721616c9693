"""Each query of the library against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from ledgerspark.plans import queries as core


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in core.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in core.ORACLE_SQL:
        assert df.columns
        return
    want = duck.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())
