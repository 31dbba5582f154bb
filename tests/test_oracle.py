"""Every registered query against DuckDB, or for rows where SQL cannot say it."""

import pytest

from skyweave.plans.catalogue import REGISTRY

from .oracle_check import compare, connect


# queries that need Python workers, or a fitted model's own functions
PYTHON = {"isolation_forest", "stl_residual", "event_classifier", "boosted_classifier", "pm25_forecast", "model_round_trip", "model_scores"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, sf_dir, name):
    q = REGISTRY[name]
    df = q.checked(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "EvalPython" not in plan and "InPandas" not in plan
    got = df.toPandas()
    if q.sql is None:
        assert len(got) > 0
    else:
        assert compare(got, con.execute(q.sql).df()) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
