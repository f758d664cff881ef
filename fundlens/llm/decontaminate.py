"""Benchmark decontamination: suffix arrays over the words of the documents, searched for every test suffix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kit

WINDOW = 13
#: Benchmark text sent to all tasks at once; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 8 << 20
#: Words of one suffix array.
SHARD_WORDS = 1 << 19
SHARD_BYTES = 2 << 20
FOUND = "n_words long, n_hit long, items array<string>, runs array<struct<first:long,words:long>>, longest long"


# -- suffix arrays --------------------------------------------------------------------------------------------


def suffix_array(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the `depth` words that follow, by prefix doubling. left: words up to the text's end, which sorts first."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order] = np.cumsum(np.append(1, words[order][1:] != words[order][:-1]))
    step = 1
    while step < depth:
        second = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > step)
        second[inside] = ranks[inside + step]
        pairs = (ranks << 32) | second
        order = np.argsort(pairs, kind="stable")
        sorted_pairs = pairs[order]
        fresh = sorted_pairs[1:] != sorted_pairs[:-1]
        ranks[order] = np.cumsum(np.append(1, fresh))
        step *= 2
        if fresh.all():
            break
    return order


def _below(words, left, order, probes, lengths, upper: bool) -> np.ndarray:
    """For each probe (a row of words), how many suffixes sort before it; upper: before or with it as prefix."""
    low, high = np.zeros(len(probes), np.int64), np.full(len(probes), len(order), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        at = order[middle]
        less, undecided = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for j in range(int(lengths[open_].max())):
            live = undecided & (j < lengths[open_])
            if not live.any():
                break
            k = np.flatnonzero(live)
            ended = left[at[k]] <= j
            word, probe = words[np.minimum(at[k] + j, len(words) - 1)], probes[open_[k], j]
            smaller, larger = ended | (word < probe), ~ended & (word > probe)
            less[k[smaller]] = True
            undecided[k[smaller | larger]] = False
        if upper:
            less |= undecided
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    return low


class Probes:
    """All windows of a block of items: a long item's `window` words from every start, a shorter item whole."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        data, offsets = kit.utf8(texts)
        words, bounds = kit.hashed_words(kit.LOWER[data], offsets, kit.ALNUM)
        found: dict[bytes, set[str]] = {}
        for (name, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            for s in range(a, max(a, b - window) + 1) if b > a else ():
                found.setdefault(words[s : min(s + window, b)].tobytes(), set()).add("null" if name is None else str(name))
        keys = sorted(found)
        self.items = [sorted(found[k]) for k in keys]
        self.lengths = np.array([len(k) // 8 for k in keys], np.int64)
        self.words = np.zeros((len(keys), window), np.uint64)
        for row, k in enumerate(keys):
            self.words[row, : len(k) // 8] = np.frombuffer(k, np.uint64)
        self.window = window

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matches in a text run: (position, probe) for each suffix that begins with a probe."""
        positions, probes = [], []
        if not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left_all = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
        step = SHARD_WORDS
        for a in range(0, len(words), step):
            shard = words[a : a + step + self.window - 1]
            left = np.minimum(left_all[a : a + len(shard)], len(shard) - np.arange(len(shard)))
            order = suffix_array(shard, left, self.window)
            first = shard[order]
            # a probe with a word that the shard lacks can't match
            distinct = first[np.append(True, first[1:] != first[:-1])]
            here = distinct[np.minimum(np.searchsorted(distinct, self.words), len(distinct) - 1)] == self.words
            able = np.flatnonzero((here | (np.arange(self.window) >= self.lengths[:, None])).all(axis=1))
            low = _below(shard, left, order, self.words[able], self.lengths[able], False)
            high = _below(shard, left, order, self.words[able], self.lengths[able], True)
            counts = high - low
            if counts.sum():
                where = np.repeat(low - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
                positions.append(order[where] + a)
                probes.append(np.repeat(able, counts))
        if not positions:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(positions), np.concatenate(probes)


# -- on Spark -------------------------------------------------------------------------------------------------


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about `block_bytes` of text, one after another."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def _merge_runs(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searched(df: DataFrame, text: str, probes, window: int, first: bool) -> DataFrame:
    """One pass over whole texts with one block of items; adds to what earlier blocks have found."""
    names = [f for f in df.columns if f != "_found"]
    schema = df.select(*names, F.lit(None).cast(f"struct<{','.join(p.replace(' ', ':', 1) for p in FOUND.split(', '))}>").alias("_found")).schema

    def find(batches, out):
        block = probes.value
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch, text, SHARD_BYTES):
                words, bounds = kit.hashed_words(kit.LOWER[data], offsets, kit.ALNUM)
                at, probe = block.search(words, bounds)
                doc = np.searchsorted(bounds, at, "right") - 1
                before = [None] * rows.num_rows if first else rows.column("_found").to_pylist()
                found = [
                    {"n_words": int(n), "n_hit": 0, "items": [], "runs": [], "longest": 0} if old is None else old
                    for n, old in zip(np.diff(bounds), before, strict=True)
                ]
                by_doc = np.argsort(doc, kind="stable")
                for group in np.split(by_doc, np.flatnonzero(np.diff(doc[by_doc])) + 1) if len(doc) else ():
                    d = int(doc[group[0]])
                    starts = at[group] - bounds[d]
                    hits = _merge_runs([*zip(starts.tolist(), (starts + block.lengths[probe[group]]).tolist(), strict=True), *((r["first"], r["first"] + r["words"]) for r in found[d]["runs"])])
                    items = set(found[d]["items"]).union(*(block.items[p] for p in np.unique(probe[group])))
                    found[d] |= {"n_hit": sum(b - a for a, b in hits), "items": sorted(items), "runs": [{"first": a, "words": b - a} for a, b in hits], "longest": max(b - a for a, b in hits)}
                yield kit.record(out, [*(rows.column(n) for n in names), pa.array(found, out.field("_found").type)])

    return kit.mapped(df, find, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct `_found`: n_words, n_hit, items, runs (first word, words) and longest, over whole texts.

    docs: text, besides any other columns but `_found`. Texts stay in their partitions: each run of documents gets a
    suffix array over its words, in which every test suffix is found by binary search. The benchmark is sent to the
    tasks in blocks of checked size, one pass each. Null and word-less texts have no matches, null or word-less items
    have no windows, repeated rows and items are judged alike, and a null item_id is listed as "null".
    """
    out, first = docs, True
    for items in benchmark_blocks(benchmark, block_bytes):
        out, first = _searched(out, "text", docs.sparkSession.sparkContext.broadcast(Probes(items, window)), window, first), False
    return _searched(out, "text", docs.sparkSession.sparkContext.broadcast(Probes([], window)), window, True) if first else out


def contaminated(found: str = "_found", share: int = 20):
    n_hit, n_words = F.col(f"{found}.n_hit"), F.col(f"{found}.n_words")
    return (n_hit > 0) & (share * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest: one row for each row of docs."""
    found = matches(docs.select("doc_id", "text"), benchmark).drop("text")
    return found.select(
        "doc_id", "_found.n_words", "_found.n_hit", F.size("_found.items").cast("long").alias("n_items"), F.sha2(F.array_join("_found.items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"), "_found.longest"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns of docs; the rest go."""
    inner, names = kit.numbered(docs)
    inner = inner.withColumnRenamed(f"c{names.index('text')}", "text")
    kept = matches(inner, benchmark).where(~contaminated()).drop("_found")
    return kept.toDF(*names)
