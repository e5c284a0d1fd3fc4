"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same_rows

from nilas import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, oracle, name):
    same_rows(spark, oracle, plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, oracle, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark, oracle):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
