import os

import pytest

from lodestar.plans import queries as engine
from tests.oracle import assert_same, connection

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_query_matches_sql(name, spark, duck):
    assert_same(engine.QUERIES[name], engine.ORACLE[name], spark, SF, duck)


def test_entry_runs_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(engine.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_reaches_the_scan(spark, capsys):
    engine.QUERIES["vector_topk_filtered"](spark, SF).explain("formatted")
    shown = capsys.readouterr().out
    assert "PushedFilters: [In(label" in shown
    assert "TakeOrderedAndProject" in shown
