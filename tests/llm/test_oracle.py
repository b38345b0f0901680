import os

import pytest

from lodestar.llm import queries as llm
from tests.oracle import assert_same, connection

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query_matches_sql(name, spark):
    assert_same(llm.QUERIES[name], llm.ORACLE[name], spark, SF, connection(SF))
