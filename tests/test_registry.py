import pytest

import __spark_entry__ as entry
from stratalens.plans import registry

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    assert same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE[name])) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
