"""Every query with SQL gives the SQL's rows; every other one runs."""

import pytest

from lexmill import queries_core as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_as_sql(name, same):
    same(q.QUERIES[name], q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(name, spark, data):
    df = q.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry_has_all(spark, data):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, data):
    plan = q.QUERIES["q_filter_range"](spark, data)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert "LessThan(l_quantity,20.0)" in pushed and "l_comment" not in pushed
