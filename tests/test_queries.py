import pytest

from linkcatalog.plans import registry
from tests import cases

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(same, name):
    same(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(cases.SQL))
def test_known_cases(same, name):
    same(cases.QUERIES[name], cases.SQL[name])


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
