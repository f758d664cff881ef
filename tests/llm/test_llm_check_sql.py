"""Queries whose results SQL can express, against their check SQL."""

import pytest
from oracle import connect

from fundlens.llm.catalog import CHECK_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(CHECK_SQL))
def test_query(spark, sf, name):
    want = connect(sf).sql(CHECK_SQL[name])
    got = QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(key, want.fetchall())) == sorted(map(key, got.select(*want.columns).collect()))


def test_all_numbered_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
