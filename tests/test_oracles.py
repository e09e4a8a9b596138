"""Every registered query of the reference's operators against its DuckDB oracle."""

import math

import duckdb
import pandas as pd
import pytest

from conftest import SF
from methloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _cells(df):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert _cells(got) == _cells(duck.sql(registry.ORACLES[name]).df())
    else:
        assert len(got) > 0
