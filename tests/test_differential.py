import pytest
from differential import differ, views

from seqloom import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    assert name in core.ORACLES
    assert differ(df, con, core.ORACLES[name]) is None
