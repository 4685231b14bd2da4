"""Every query with SQL gives what DuckDB makes of the SQL, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from foliant.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}'")
    return con


def _rows(df):
    plain = lambda x: None if x is None or pd.isna(x) is True else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert _rows(QUERIES[name](spark, DATA).toPandas()) == _rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
