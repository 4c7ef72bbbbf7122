"""Each query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(pdf, cols):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        return round(float(v), 8) if not isinstance(v, str) else v

    return sorted((tuple(map(plain, r)) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    expected = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got, sorted(got.columns)) == rows(expected, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["s1_id", "candidate_id", "score", "rank"]


def test_resume(spark):
    assert __spark_entry__.queries()["resume_stream"](spark, SF).count() == 67
