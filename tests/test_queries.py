"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {"train_heads"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "action", "n", "mean_score"]
