"""Every named query against its check SQL, on the smallest data."""

import pytest
from oracle import compare, connect

from fundlens.plans.catalog import CHECK_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name)
    assert ok, note


def test_only_order_dependent_queries_go_without_check_sql():
    assert set(QUERIES) - set(CHECK_SQL) == {"phrase_dedup", "call_sheet", "sheet_markdown"}
