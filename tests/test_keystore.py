"""The key store against a dictionary, over many batches, with repeated batches and dead writers."""

import random

from pyspark.sql import functions as F

from fundlens.streaming.keystore import KeyStore


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, call_id bigint").coalesce(1)


def found(store, spark, keys, batch_id):
    return {r.key: r.call_id for r in store.find(frame(spark, [(k, None) for k in keys]), batch_id).collect()}


def test_lookups_over_many_batches(spark, tmp_path):
    """Answers are those of a dictionary; segments, and so files that a lookup opens, stay few."""
    rng, store, held = random.Random(3), KeyStore(spark, str(tmp_path / "keys"), buckets=4, fan=3), {}
    for batch_id in range(20):
        rows = [(f"k{rng.randrange(40)}", rng.randrange(1000)) for _ in range(5)]
        asked = [f"k{i}" for i in range(0, 40, 7)] + [None]
        if batch_id % 5 == 0:
            assert found(store, spark, asked, batch_id) == {k: held[k] for k in asked if k in held}
        store.add(frame(spark, rows + [(None, 1)]), batch_id)
        store.tidy(batch_id)
        for k, i in rows:
            held[k] = min(i, held.get(k, i))
        assert len(store.before(batch_id + 1)) <= 2 * 3 and len(store.segments()) <= 3 * 3 + 2
    assert found(store, spark, list(held), 20) == held


def test_a_batch_reads_only_its_own_buckets(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"), buckets=64)
    store.add(frame(spark, [(f"k{i}", i) for i in range(2000)]), 0)
    asked = store.find(frame(spark, [("k7", None)]), 1)
    plan = asked._jdf.queryExecution().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "bucket" in filters.split("PartitionFilters")[1].split("]")[0] and asked.collect() == [("k7", 7)]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    every = store._read([(0, 0)])
    assert files(every.where(F.col("bucket").isin([3]))) <= 1 < files(every)


def test_repeated_batches_and_dead_writers(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"), buckets=4, fan=2)
    for _ in range(2):  # the second time each batch finds what it found the first time
        for batch_id, key in enumerate("abcd"):
            assert found(store, spark, list("abcd"), batch_id) == {k: i for i, k in enumerate("abcd"[:batch_id])}
            store.add(frame(spark, [(key, batch_id)]), batch_id)
    store.tidy(4)
    assert store.segments() == [(0, 3)] and found(store, spark, list("abcd"), 4) == dict(zip("abcd", range(4)))
    store._write(frame(spark, [("e", 9)]), 4, 4)
    (tmp_path / "keys" / "seg=4-4" / "_SUCCESS").unlink()  # as if the writer had died
    assert found(store, spark, ["e"], 5) == {}
    assert found(store, spark, ["a"], 0) == {} and found(KeyStore(spark, str(tmp_path / "none")), spark, ["a"], 3) == {}
