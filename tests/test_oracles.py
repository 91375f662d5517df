"""Every core query against its SQL on the smallest tables, as multisets of rows."""

import os

import duckdb
import pandas as pd
import pytest

from veinstone import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_sql(spark, db, name):
    got, want = core.QUERIES[name](spark, DIR).toPandas(), db.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DIR).count() > 0
