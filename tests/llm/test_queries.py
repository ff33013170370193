"""Each query on the driver's small tables; those with SQL against an independent engine."""

import os

import pytest

from scriptorium.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if sql := queries.ORACLE_SQL.get(name):
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = con.execute(sql).df()
        plain = lambda df: sorted(tuple(None if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
        assert sorted(got.columns) == sorted(want.columns)
        fix = lambda rows: sorted(tuple("null" if v is None or v in ("<NA>", "nan") else v.removesuffix(".0") for v in r) for r in rows)
        assert fix(plain(got.where(got.notna(), None))) == fix(plain(want.astype(object).where(want.notna(), None)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    said = queries.QUERIES["op3_langid"](spark, DATA).where("held_out and lang_pred <> 'und'").join(docs, "doc_id").where("lang is not null").collect()
    assert len(said) > 20 and sum(r["lang"] == r["lang_pred"] for r in said) >= 0.95 * len(said)
