import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import SF_DIR, assert_same  # noqa: E402

from tessella.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_a_row_for_each_document(spark, name):
    out = Q.queries()[name](spark, SF_DIR)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(200))
