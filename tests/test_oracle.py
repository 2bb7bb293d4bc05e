"""Every query of the engine with SQL gives the rows that its SQL gives."""

import pytest

from tests.compare import connect, same_rows
from tracewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows(spark, con, name):
    same_rows(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b", "n", "strength"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
