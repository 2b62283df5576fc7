"""Every registered query of the reference's operators, against its SQL where there is one."""

import pytest
from answerscope.plans import assurance, facts, kpis, lifecycle, operations, registry, relational, rules, scalars, series, states  # noqa: F401
from oracle import connect, same


@pytest.fixture(scope="module")
def sql(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, data, sql, name):
    same(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], sql)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
