"""Every registered panel query against its SQL, on the smallest tables."""

import pytest

import oracle
from panelkit.plans import registry

SLOW = {"ml_tune_timesplit", "ml_walkforward"}


@pytest.fixture(scope="module")
def con():
    return oracle.connection("/root/testdata/sf0.001")


def test_every_query_but_models_has_sql():
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"ml_fit_regression", "ml_score_panel", "ml_tune_timesplit", "ml_importance", "ml_walkforward"}
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert oracle.differences(df, registry.oracle_sql()[name], con) == ""


@pytest.mark.parametrize("name", ["ml_importance", "ml_score_panel"])
def test_models_run(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
