"""Every registered query against its check SQL at the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from rosterline.plans import catalog
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    text, _, ok = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), sf)
    assert ok, text
    assert "EMPTY" not in text and text != "rows-only 0"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["msg_id", "block_id"] and df.count() == 150


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
