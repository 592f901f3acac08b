import pytest

from ledgerline.plans import registry
from tests.oracle import connect, rows

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_python_in_plans(spark, sf):
    for name in ("validate_contract", "profile_lineitem", "drift_events", "etl_event_records"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "EvalPython" not in plan, name


def test_checks_scan_once(spark, sf):
    plan = registry.QUERIES["validate_with_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
