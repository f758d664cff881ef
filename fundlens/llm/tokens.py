"""Token ids as Parquet list columns that can be read by column and by row range."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kit

#: What is written, in this order: `ids` last and on its own, so that reading the others leaves it alone.
LAYOUT = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 1_500_000
#: Words of letters, perhaps with punctuation behind: one or two pieces to the tokenizer, so that many go in one call.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([.,;:!?]*)")


class WordIds:
    """Ids of words by hash. The tokenizer joins nothing across blanks, so a word's ids are the same in any text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_piece = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted; at and size follow its order
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.recent: list = []  # tables not merged yet
        self.flat, self.used, self.words = np.empty(1 << 16, np.uint32), 0, 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has."""
        plain = [_PLAIN.fullmatch(w) for w in words]
        some = np.array([i for i, m in enumerate(plain) if m], np.int64)
        parts = [some[a : a + 4096] for a in range(0, len(some), 4096)]
        joined = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in part]) for part in parts], add_special_tokens=False)
        sizes, found, done = np.zeros(len(words), np.int64), [], np.zeros(len(words), bool)
        for part, got in zip(parts, joined, strict=True):
            ids = np.array(got.ids, np.uint32)
            pieces = np.cumsum([2 if plain[i][1] else 1 for i in part.tolist()])
            cuts = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(cuts) == pieces[-1]:
                sizes[part], done[part] = np.diff(cuts[pieces - 1], prepend=0), True
                found.append((part, ids))
        alone = np.flatnonzero(~done)
        got = [np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32) for i in alone.tolist()]
        sizes[alone] = [len(g) for g in got]
        found.append((alone, np.concatenate(got) if got else np.empty(0, np.uint32)))
        flat, starts = np.empty(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for part, ids in found:
            flat[kit.ragged(starts[part], sizes[part])] = ids
        return flat, sizes

    def _find(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray, table) -> None:
        known, starts, sizes = table
        if len(known):
            i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[i] == keys
            at[hit], size[hit] = starts[i[hit]], sizes[i[hit]]

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text closed by `end_id`; and the ids of each text counted."""
        starts, ends = kit.word_bounds(data, offsets, kit.NOT_BLANK)
        bounds = np.searchsorted(starts, offsets)
        keys, first, which = np.unique(kit.spans_hashed(data, starts, ends), return_index=True, return_inverse=True)
        if self.words > REMEMBERED:
            self.forget()
        at, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for table in ((self.keys, self.at, self.size), *self.recent):
            self._find(keys, at, size, table)
        new = np.flatnonzero(at < 0)
        if len(new):
            text = data.tobytes()
            more, size[new] = self.encode([text[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at[new] = self.used + np.cumsum(size[new]) - size[new]
            if self.used + len(more) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), len(more)), np.uint32)])
            self.flat[self.used : self.used + len(more)] = more
            self.used += len(more)
            self.words += len(new)
            self.recent.append((keys[new], at[new], size[new]))
            if sum(len(t[0]) for t in self.recent) > max(100_000, len(self.keys) // 4):
                tables = [(self.keys, self.at, self.size), *self.recent]
                merged = [np.concatenate([t[k] for t in tables]) for k in range(3)]
                order = np.argsort(merged[0])
                self.keys, self.at, self.size = (m[order] for m in merged)
                self.recent = []
        sizes = size[which]
        total = np.append(0, np.cumsum(sizes))[bounds]
        counts = np.diff(total) + 1
        out = np.full(int(counts.sum()), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[inner] = self.flat[kit.ragged(at[which], sizes)]
        return out, counts


_words: WordIds | None = None


def word_ids(path: str) -> WordIds:
    """This worker's table of words, kept from task to task."""
    global _words
    if _words is None or _words.path != path:
        _words = WordIds(path)
    return _words


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes doc_id and token ids (whole text, then `end_id`) in ascending doc_id order.

    Rows are range-partitioned and sorted by doc_id (nulls first, ties by text), so file and row group statistics and
    the page index bound doc_id: a range of documents is read without the rest, and metadata without `ids`. Ids are
    dictionary encoded while a row group's distinct ids fit, plainly packed otherwise. `part` and `part_start` place a
    document in its part; `document_starts` turns them into global positions. Null text counts as empty: it gets
    the end id alone. Repeated rows are written as often as they come. An empty table gives a table without rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches, schema):
        part, start = TaskContext.get().partitionId(), 0
        known = word_ids(tokenizer)
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch):
                ids, sizes = known.ids(data, offsets, end_id)
                ends = np.cumsum(sizes)
                flat = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32)))
                yield kit.record(schema, [rows.column("doc_id"), np.full(len(sizes), part, np.int32), start + ends - sizes, sizes, flat])
                start += int(ends[-1])

    (
        kit.mapped(ordered, encode, LAYOUT)
        .write.option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def document_starts(files: DataFrame) -> DataFrame:
    """(part, base): how many ids stand before each part; made from part numbers and counts alone, one row a part."""
    from pyspark.sql import Window

    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).parquet(path)


def token_index(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, from written files only."""

    def sums(batches, schema):
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.flatten().to_numpy().astype("<u4", copy=False), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield kit.record(schema, [*(batch.column(i) for i in range(4)), np.array(crc, np.int64)])

    rows = kit.mapped(files, sums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    starts = document_starts(files)
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
