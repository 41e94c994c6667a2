import pytest

from tests.oracle import assert_same, connect
from tidewell.plans import catalogue, stored, values  # noqa: F401  two register their queries with those of catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), connect(sf_dir).sql(catalogue.ORACLES[name]))


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0, name


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["cursor_page"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,1000)" in plan
    assert "o_comment" not in plan and "TakeOrderedAndProject" in plan
