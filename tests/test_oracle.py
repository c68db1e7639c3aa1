"""Every registered query against its check SQL; queries without SQL must at least return rows."""

import __spark_entry__ as entry
import pytest

from marketpulse.plans import catalog

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).limit(1).count() == 1
        return
    ok, note = compare(spark, con, SF, query, sql)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_unchecked_queries_are_few():
    free = set(catalog.queries()) - set(catalog.oracle_sql())
    assert free == {"text_classifier"}
