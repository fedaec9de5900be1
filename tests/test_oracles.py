"""Every registered query equals its check SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checking import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_check_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["neuron", "row", "col", "n", "mean_distance"]
    assert found.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
