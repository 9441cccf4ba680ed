"""Every query with a DuckDB twin gives the same rows; the others run."""

import pytest

from quillstone import catalog

from .compare import assert_twins


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, sf_dir, name):
    assert_twins(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and "spell_month_panel" in queries


def test_flagship_plan_moves_no_month_rows(spark, sf_dir):
    """The months are generated beside the flows: two shuffles of flows, one of
    operations, none of the months at risk."""
    plan = catalog._summary(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
