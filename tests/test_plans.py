"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool | str):
            return str(v)
        try:
            return f"{round(float(v), 6) + 0.0:.6f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
