"""Every registered query with checking SQL gives the same rows in both engines."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal(spark, con, name):
    assert compare(spark, con, name, SF)[0] == "equal"


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "formula" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
