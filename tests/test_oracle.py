"""Every query with SQL gives the same rows as DuckDB over the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from veldspar.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in plans.ORACLES:
        assert got
        return
    want = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
