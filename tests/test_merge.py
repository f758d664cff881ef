"""The bucketed table against a dictionary: partial rewrites, dead and concurrent merges."""

import pytest

from fundlens.sources.merge import BucketTable

SCHEMA = "call_id bigint, title string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).coalesce(1)


def held(table):
    return {r.call_id: r.title for r in table.read(SCHEMA).collect()}


def test_merges_agree_with_a_dictionary_and_touch_own_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "call_id", buckets=8)
    assert held(table) == {} and table.merge(frame(spark, [])) == 0
    want = {i: f"t{i}" for i in range(40)}
    table.merge(frame(spark, list(want.items()) + [(None, "x")]))
    assert held(table) == want | {None: "x"}
    before = table.manifest()
    table.merge(frame(spark, [(7, "late", 2), (7, "early", 1)], SCHEMA + ", n int"), arrival="n")
    after = table.manifest()
    assert held(table) == want | {None: "x", 7: "late"}
    assert set(after) == set(before) and sum(before[k] != after[k] for k in before) == 1
    table.merge(frame(spark, [(3, "gone too"), (90, "new")]), gone=frame(spark, [(3,), (4,)], "call_id bigint"))
    assert held(table) == {k: v for k, v in (want | {None: "x", 7: "late", 90: "new"}).items() if k not in (3, 4)}
    assert {r.call_id for r in table.read(SCHEMA, version=1).collect()} == {*want, None}


def test_a_merge_that_dies_or_comes_second_is_invisible(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "t"), "call_id", buckets=4)
    table.merge(frame(spark, [(1, "a"), (2, "b")]))
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            table.merge(frame(spark, [(1, "c"), (3, "d")]))
    assert held(table) == {1: "a", 2: "b"} and table.version() == 1
    table.merge(frame(spark, [(1, "c"), (3, "d")]))
    assert held(table) == {1: "c", 2: "b", 3: "d"}
    with pytest.raises(RuntimeError):
        table._publish({}, 2)
    assert held(table) == {1: "c", 2: "b", 3: "d"}


def test_all_rows_of_a_bucket_may_leave(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "call_id", buckets=4)
    table.merge(frame(spark, [(1, "a")]))
    table.merge(frame(spark, []), gone=frame(spark, [(1,)], "call_id bigint"))
    assert held(table) == {} and table.version() == 2
