"""Every registered query against its SQL at the smallest scale; those without SQL give rows."""

import pytest

from kindred import plans

from . import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert oracle.differences(plans.QUERIES[name](spark, sf_dir), con, plans.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_gives_rows(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
