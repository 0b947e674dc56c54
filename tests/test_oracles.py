"""Every query with SQL beside it gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from corpusloom.plans.catalogue import ENTRIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if hasattr(x, "tolist") and not isinstance(x, list | tuple):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return repr([cell(y) for y in x])
    if x is None or pd.isna(x):
        return "None"
    if isinstance(x, bool):
        return repr(x)
    if isinstance(x, int | float):
        return repr(round(float(x), 9) + 0.0)
    return repr(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, duck, name):
    found = ENTRIES[name].build(spark, SF).toPandas()
    if ENTRIES[name].sql is None:
        assert len(found) > 0
        return
    wanted = duck.execute(ENTRIES[name].sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
