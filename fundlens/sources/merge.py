"""A stored table that upserts change bucket by bucket; readers follow a manifest, so a merge shows whole or not at all."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import upkeep

BUCKETS = 256


class BucketTable:
    """Rows by key, in Parquet folders by hash of the key. A row with a null key replaces none and is added.

    A merge reads and rewrites only the buckets that its own keys fall in, into a new folder, and then adds a manifest
    (bucket -> folder, at most one line a bucket) under the next number. What a merge that dies has written is in no
    manifest. A merge that finds its number taken raises and may run again; two at the very same moment are told apart
    only where the file system's rename does not replace files.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """Number of the newest manifest; 0 where the table holds nothing."""
        return max((int(m[1]) for n in self._names(f"{self.root}/manifests") if (m := re.fullmatch(r"(\d+)\.json", n))), default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that holds rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(lines).items()}

    def read(self, schema, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest one), or of some buckets of it."""
        held = self.manifest(version)
        paths = [f"{self.root}/{v}" for k, v in held.items() if only is None or k in set(only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, incoming: DataFrame, arrival: str | None = None, gone: DataFrame | None = None) -> int:
        """Incoming rows replace those of their keys or are added, keys of `gone` leave; returns the new version.

        Of several incoming rows of a key the last by `arrival` stays, as in upkeep.upsert; a key both incoming and gone
        leaves. The table keeps the columns of the incoming rows without `arrival`. With nothing to do the version stays.
        """
        version = self.version()
        held = self.manifest(version)
        rows = incoming.drop(arrival) if arrival else incoming
        keys = incoming.select(self.key) if gone is None else incoming.select(self.key).union(gone.select(self.key))
        asked = sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # at most one row a bucket
        if not asked:
            return version
        merged = upkeep.upsert(self.read(rows.schema, version, asked), incoming, self.key, arrival)
        if gone is not None:
            merged = merged.join(gone.select(self.key).distinct(), self.key, "left_anti").select(rows.columns)
        folder = f"data/{version + 1}-{uuid.uuid4().hex}"
        merged.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        written = {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(f"{self.root}/{folder}") if n.startswith("_bucket=")}
        self._publish({k: v for k, v in held.items() if k not in set(asked)} | written, version + 1)
        return version + 1

    def _publish(self, held: dict[int, str], version: int) -> None:
        place, draft = self._path(f"{self.root}/manifests/{version}.json"), self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(held), "utf-8"))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(draft, place):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was published by another merge")
