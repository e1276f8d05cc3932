import pytest

import __spark_entry__ as e
from checks.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(e.queries()))
def test_query_agrees_with_sql(spark, oracle, name):
    said, _ = difference(spark, oracle, e.queries()[name], e.oracle_sql().get(name), SF_DIR)
    assert said == ""
