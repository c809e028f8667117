"""Every query with oracle SQL agrees with it on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(oracle_sql())))
def test_agrees(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], SF) == ""


def test_entry_has_rows(spark):
    assert not entry(spark).isEmpty()


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
