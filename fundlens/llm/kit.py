"""Helpers shared by the operators: scratch tables, Arrow batches, vectorised words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text that a task works on at a time.
CHUNK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that belong to a word: all but blanks; or letters, digits and what is not ASCII (after lower-casing).
NOT_BLANK = ~_BLANK
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


# -- scratch tables -------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` or the context's checkpoint folder.

    Only in a local session, where the executors are this machine, a temporary folder stands in for it.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("fundlens.scratch.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fundlens-")
        spark.conf.set("fundlens.scratch.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[tuple[SparkSession, str]]] = []


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a scratch table, wherever the cluster keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those stored with keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            deleted(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted as soon as it ends, not when the driver forgets its plan.

    For steps that store their results, so that no later one reads those files.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def stored(df: DataFrame, name: str, keep: bool = False, **options) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if _scopes and not keep:
        _scopes[-1].append((df.sparkSession, path))
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Parts for data that are dealt out by a key."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with columns c0, c1, ..., so that no name of its own can clash, and its names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns


def named(df: DataFrame, names: list[str], extra: list[Column] = ()) -> DataFrame:
    return df.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), *extra)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def share(key: Column, seed: int) -> Column:
    """An even number in [0, 1) made from a key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


# -- Arrow ----------------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of a string column."""
    if not batch.num_rows:
        return
    data, offsets = utf8(batch.column(column))
    for a, b in runs(offsets, most):
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def mapped(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with run(batches, Arrow schema of the result)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kind)

    def task(batches):
        try:
            yield from run(batches, out)
        finally:
            released()

    return df.mapInArrow(task, kind)


def released() -> None:
    """Gives memory that a task has done with back to the machine; workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type != f.type else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# -- words ----------------------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums; a slice's hash follows from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0][:-1], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums) - 1)[1][starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; no word crosses a text's end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside[1:-1] & ~before), np.flatnonzero(inside[1:-1] & ~after) + 1


def spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each of some ordered spans. Long texts are hashed piece by piece."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        a, b = starts[at], ends[to - 1]
        out[at:to] = slice_hashes(prefix_hashes(data[a:b]), starts[at:to] - a, ends[at:to] - a)
        at = to
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and the n + 1 word offsets of the texts."""
    starts, ends = word_bounds(data, offsets, member)
    return spans_hashed(data, starts, ends), np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size, all in one array."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


# -- bounded samples of labelled rows ---------------------------------------------------------------------------


def group_sizes(rows: DataFrame, group: str) -> dict:
    """Rows of each value of a column of few values."""
    return {r[0]: r[1] for r in rows.groupBy(group).agg(F.count("*")).collect()}


def sampled(rows: DataFrame, key: str, group: str, sizes: dict, most: int, seed: int) -> DataFrame:
    """Rows of each group by hash of the key, `most` a group in expectation (all, if it has no more). Same rows each run, no shuffle."""
    n = F.lit(0.0)
    for value, size in sizes.items():
        n = F.when(F.col(group) == F.lit(value), F.lit(float(size))).otherwise(n)
    return rows.where(n > 0).where(share(F.coalesce(F.col(key).cast("string"), F.lit("")), seed) * n < most)
