"""The operators' queries against their SQL."""

import pytest

from compare import differences
from flatscan.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), sql.oracle_sql()[name], SF) == []
