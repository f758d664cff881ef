"""A store of keys that grows by batches: partitioned by hash, sorted, merged in tiers, read only where a batch's own keys fall."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = "key string, call_id bigint, bucket int"
#: Parts by hash of the key, and segments that are merged into one of the next tier.
BUCKETS = 256
FAN = 8


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class KeyStore:
    """Keys with the smallest call_id each. Every batch adds one segment; FAN segments of a tier become one of the next.

    A segment `seg=a-b` holds the keys of batches a to b, in one folder a bucket, sorted by key. It counts once its job
    has committed, so a writer that dies leaves nothing behind that a reader would see. A batch that runs again reads
    only segments of batches before it and replaces its own. A key is rewritten once a tier, and a lookup opens at most
    FAN - 1 segments a tier, so neither grows with the number of batches but by its logarithm.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.root, self.buckets, self.fan = spark, root.rstrip("/"), buckets, fan
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[tuple[int, int]]:
        """First and last batch of all complete segments."""
        if not self._fs.exists(self._path(self.root)):
            return []
        found = []
        for status in self._fs.listStatus(self._path(self.root)):
            named = re.fullmatch(r"seg=(\d+)-(\d+)", status.getPath().getName())
            if named and self._fs.exists(self._path(status.getPath(), "_SUCCESS")):
                found.append((int(named[1]), int(named[2])))
        return sorted(found)

    def before(self, batch_id: int) -> list[tuple[int, int]]:
        """The widest segments that hold the keys of all batches before this one, none twice."""
        out, end = [], -1
        for a, b in sorted((s for s in self.segments() if s[1] < batch_id), key=lambda s: (s[0], -s[1])):
            if a > end:
                out.append((a, b))
                end = b
        return out

    def _read(self, segments: list[tuple[int, int]]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], KEYS)
        paths = [f"{self.root}/seg={a}-{b}" for a, b in segments]
        return self.spark.read.schema(KEYS).option("basePath", self.root).parquet(*paths).select("key", "call_id", "bucket")

    def _write(self, keys: DataFrame, a: int, b: int) -> None:
        once = keys.where("key is not null").groupBy("key").agg(F.min("call_id").alias("call_id")).withColumn("bucket", bucket(F.col("key"), self.buckets))
        once.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/seg={a}-{b}")

    def add(self, keys: DataFrame, batch_id: int, first: int | None = None) -> None:
        """Stores the keys (key, call_id) of a batch, or of all batches from `first` on, and merges full tiers."""
        self._write(keys, batch_id if first is None else first, batch_id)
        size = self.fan
        while (batch_id + 1) % size == 0:
            start = batch_id + 1 - size
            parts = [s for s in self.before(batch_id) if s[0] >= start] + ([(batch_id, batch_id)] if first is None else [])
            if len(parts) > 1 and (start, batch_id) not in self.segments():
                self._write(self._read(parts), start, batch_id)
            size *= self.fan

    def tidy(self, batch_id: int) -> None:
        """Deletes segments that a wider one of batches before this one holds too; called when those batches are done."""
        done = [s for s in self.segments() if s[1] < batch_id]
        for a, b in done:
            if any(c <= a and b <= d and (a, b) != (c, d) for c, d in done):
                self._fs.delete(self._path(f"{self.root}/seg={a}-{b}"), True)

    def find(self, wanted: DataFrame, batch_id: int) -> DataFrame:
        """key and call_id of those of the wanted keys that batches before this one have stored.

        Only buckets that wanted keys fall in are read; their numbers, at most as many as there are buckets, decide the files.
        """
        asked = wanted.where("key is not null").select("key").distinct().withColumn("bucket", bucket(F.col("key"), self.buckets))
        segments = self.before(batch_id)
        if not segments:
            return self.spark.createDataFrame([], "key string, call_id bigint")
        touched = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        held = self._read(segments).where(F.col("bucket").isin(touched) if touched else F.lit(False))
        return held.join(asked, ["bucket", "key"], "left_semi").groupBy("key").agg(F.min("call_id").alias("call_id"))
