"""Every query of the catalogue that has SQL gives what an independent engine gives; the others run."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from scriptorium import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df):
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if sql := catalogue.ORACLE_SQL.get(name):
        assert plain(got) == plain(duck.execute(sql).df())
    else:
        assert len(got)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
