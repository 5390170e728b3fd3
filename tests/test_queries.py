import pytest
from compare import SF_DIR, assert_same

from tessella import plans
from tessella.registry import RUNS, SQL

plans.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, RUNS[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert RUNS[name](spark, SF_DIR).count() > 0
