"""Language-model scoring: corpus counts and a gated recurrent model, over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import gru, kit

#: Text of one block: documents that share a word table and are scored together.
BLOCK_BYTES = 8 << 20
#: Passes over all documents that are not held out, the same for every block.
PASSES = 3
LANES = 512
END_HASH = 0
CLASSES = gru.WORDS // gru.IN_CLASS
#: A block: its documents, their words as numbers in the block's word table (bytes in three planes), and that table.
BLOCK = "block long, docs array<struct<doc_id:long,held_out:boolean,n:int>>, words binary, hashes binary, rare binary, counts binary"


# -- blocks ---------------------------------------------------------------------------------------------------


def rare_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of a word outside the vocabulary, from its first two bytes."""
    first, second = data[starts].astype(np.int64), data[np.minimum(starts + 1, ends - 1)].astype(np.int64)
    return (((first * 256 + second) * 40503) >> 4) % gru.RARE


def planes(n: np.ndarray) -> bytes:
    return np.ascontiguousarray(n.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    three = np.frombuffer(b, np.uint8).reshape(3, -1).astype(np.int64)
    return three[0] | three[1] << 8 | three[2] << 16


def coded(docs: DataFrame, held_out) -> DataFrame:
    """Blocks of whole documents. Words of all documents get numbers; counts are those of the documents not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))

    def run(batches, out):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some, raw, offsets in kit.chunks(batch, "text", BLOCK_BYTES):
                data = kit.LOWER[raw]
                starts, ends = kit.word_bounds(data, offsets, kit.NOT_BLANK)
                bounds = np.searchsorted(starts, offsets)
                hashes, first, which, n = np.unique(kit.spans_hashed(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")  # frequent words get small numbers
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                words = place[which]
                learned = np.repeat(~some.column("held_out").to_numpy(zero_copy_only=False), np.diff(bounds))
                counts = np.bincount(words[learned], minlength=len(order))
                rare = rare_class(data, starts[first[order]], ends[first[order]])
                listed = pa.StructArray.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(np.diff(bounds), pa.int32())], ["doc_id", "held_out", "n"])
                cells = [[part << 32 | number], pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), *([x] for x in (planes(words), hashes[order].astype("<u8").tobytes(), rare.astype(np.uint8).tobytes(), counts.astype("<u4").tobytes()))]
                yield kit.record(out, cells)
                number += 1

    return kit.mapped(rows, run, BLOCK)


def word_tables(blocks: DataFrame) -> DataFrame:
    """block, number, hash, rare, n: a row for each word of each block."""

    def run(batches, out):
        for batch in batches:
            for b, h, r, c in zip(*(batch.column(k).to_pylist() for k in ("block", "hashes", "rare", "counts")), strict=True):
                hashes = np.frombuffer(h, "<i8")
                yield kit.record(out, [np.full(len(hashes), b), np.arange(len(hashes), dtype=np.int32), hashes, np.frombuffer(r, np.uint8).astype(np.int16), np.frombuffer(c, "<u4").astype(np.int64)])

    return kit.mapped(blocks.select("block", "hashes", "rare", "counts"), run, "block long, number int, hash long, rare short, n long")


# -- statistics and weights -----------------------------------------------------------------------------------


class Corpus:
    """What the driver keeps of the counts, of a fixed size: totals, the most frequent words, and sums by class of the others."""

    def __init__(self, totals: DataFrame, ends: int):
        n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.tokens, self.types = n + ends, v + (ends > 0)
        top = totals.orderBy(F.desc("n"), "hash").limit(gru.WORDS - 1).collect()
        self.top_hashes = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
        self.order = np.argsort(self.top_hashes)
        self.mass = np.zeros(gru.RARE)
        self.kinds = np.zeros(gru.RARE)
        for r in totals.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.mass[r["rare"]], self.kinds[r["rare"]] = r["n"], r["v"]
        for r in top:
            self.mass[r["rare"]] -= r["n"]
            self.kinds[r["rare"]] -= 1
        counts = np.full(gru.WORDS, 0.01)  # unused places, of next to no probability
        counts[0] = max(ends, 0.5)
        counts[1 : 1 + len(top)] = [r["n"] for r in top]
        self.ends = ends
        inside = counts.reshape(CLASSES, gru.IN_CLASS)
        of_class = np.append(inside.sum(axis=1), self.mass + self.kinds + 1)
        self.net = gru.Net.fresh(of_class / of_class.sum(), inside / inside.sum(axis=1, keepdims=True))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Model numbers of words, 0 for those outside the vocabulary (0 itself is the end)."""
        if not len(self.order):
            return np.zeros(len(hashes), np.int64)
        known = self.top_hashes[self.order]
        i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[i] == hashes, self.order[i] + 1, 0)

    def streams(self, words: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, rare: np.ndarray, lanes: int):
        """Model inputs of some documents, their classes and places in them, and for each position the word's number (-1: end)."""
        place = self.place(hashes)
        model = np.where(place > 0, place, gru.WORDS + rare)
        cls = np.where(place > 0, place // gru.IN_CLASS, CLASSES + rare)
        inside = np.where(place > 0, place % gru.IN_CLASS, -1)
        last = np.cumsum(sizes + 1) - 1
        number = np.full(len(words) + len(sizes), -1)
        body = np.ones(len(number), bool)
        body[last] = False
        number[body] = words
        at_end = number < 0
        safe = np.where(at_end, 0, number)
        if not len(hashes):
            model = cls = inside = np.zeros(1, np.int64)
        pick = lambda table: np.where(at_end, 0, table[safe])
        return gru.Streams(pick(model), np.append(0, last + 1), lanes), pick(cls), pick(inside), number


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return from_planes(row["words"]), np.array([d["n"] for d in row["docs"]], np.int64), np.frombuffer(row["hashes"], "<u8"), np.frombuffer(row["rare"], np.uint8).astype(np.int64)


def trained(blocks: DataFrame, corpus: Corpus) -> np.ndarray:
    """Weights after PASSES passes over all documents not held out, the same in every block.

    Each task goes through its blocks in turn; the tasks' weights are averaged by the tokens they have seen, in a few
    groups before the driver, which holds as many sets of weights as there are groups.
    """
    spark = blocks.sparkSession
    some = blocks.select("block", "docs", "words", "hashes", "rare")

    def passes(start):
        def run(batches, out):
            net, memory, seen = gru.Net(start.value[0].copy()), start.value[1].copy(), 0
            for batch in batches:
                for row in batch.to_pylist():
                    words, sizes, hashes, rare = _texts(row)
                    chosen = np.array([not d["held_out"] for d in row["docs"]], bool)
                    mine = words[np.repeat(chosen, sizes)]
                    streams, cls, inside, _ = corpus_of.value.streams(mine, sizes[chosen], hashes, rare, gru.LANES)
                    gru.train(net, memory, streams, cls, inside)
                    seen += len(streams.words)
            if seen:
                yield kit.record(out, [[seen], [net.flat.tobytes()], [memory.tobytes()]])

        return run

    def averaged(batches, out):
        total, flat, memory = 0, 0.0, 0.0
        for batch in batches:
            for n, w, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                total += n
                flat, memory = flat + n * np.frombuffer(w, np.float32).astype(float), memory + n * np.frombuffer(m, np.float32).astype(float)
        if total:
            yield kit.record(out, [[total], [(flat / total).astype(np.float32).tobytes()], [(memory / total).astype(np.float32).tobytes()]])

    kind = "n long, weights binary, memory binary"
    corpus_of = spark.sparkContext.broadcast(corpus)
    weights, memory = corpus.net.flat, np.zeros_like(corpus.net.flat)
    for _ in range(PASSES):
        results = kit.mapped(some, passes(spark.sparkContext.broadcast((weights, memory))), kind)
        groups = kit.mapped(results.repartition(8), averaged, kind).collect()
        if total := sum(r["n"] for r in groups):
            weights = (sum(r["n"] * np.frombuffer(r["weights"], np.float32).astype(float) for r in groups) / total).astype(np.float32)
            memory = (sum(r["n"] * np.frombuffer(r["memory"], np.float32).astype(float) for r in groups) / total).astype(np.float32)
    return weights


# -- scores ---------------------------------------------------------------------------------------------------


def scores(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs (doc_id, text).

    Counts cover all documents not held out; each block of documents gets the corpus counts of its own words back, so no
    task and no driver holds the corpus vocabulary. The recurrent model predicts classes of all words and, inside the
    classes of frequent ones, the words; inside the classes of the others, words share the probability by count plus
    one, with one share for all unseen words. Null, empty and blank texts are the end token alone; repeated rows score
    alike; with no training documents every count is zero and the weights stay as they start.
    """
    spark = docs.sparkSession
    blocks = kit.stored(coded(docs, held_out), "lm-blocks")
    tables = word_tables(blocks)
    totals = kit.stored(tables.where("n > 0").groupBy("hash").agg(F.sum("n").alias("n"), F.first("rare").alias("rare")), "lm-counts")
    ends = blocks.select(F.coalesce(F.sum(F.size(F.filter("docs", lambda d: ~d["held_out"]))), F.lit(0)).alias("n")).first()["n"]
    corpus = Corpus(totals, int(ends))
    shared = spark.sparkContext.broadcast((corpus, trained(blocks, corpus)))

    # both sides grow with the corpus: sorted and merged at any size
    known = tables.select("block", "number", "hash").join(totals.select(F.col("hash").alias("h"), F.col("n").alias("c")).hint("merge"), F.col("hash") == F.col("h")).select("block", "number", "c")
    counted = known.groupBy("block").agg(F.collect_list(F.struct("number", "c")).alias("known")).select(F.col("block").alias("b"), "known")
    rows = blocks.select("block", "docs", "words", "hashes", "rare").join(counted.hint("merge"), F.col("block") == F.col("b"), "left").select("docs", "words", "hashes", "rare", "known")

    def run(batches, out):
        corpus, weights = shared.value
        net = gru.Net(weights)
        n, v = corpus.tokens, corpus.types
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("docs", "words", "hashes", "rare")}
                words, sizes, hashes, rare = _texts(row)
                count = np.zeros(len(hashes) + 1)  # the end token's comes last: number -1
                count[-1] = corpus.ends
                known = batch.column("known")[i].values
                if known is not None:
                    count[known.field("number").to_numpy()] = known.field("c").to_numpy()
                streams, cls, inside, number = corpus.streams(words, sizes, hashes, rare, LANES)
                p = gru.score(net, streams, cls, inside) / np.log(10)
                outside = np.flatnonzero(inside < 0)
                k = cls[outside] - CLASSES
                p[outside] += np.log10((count[number[outside]] + 1) / (corpus.mass[k] + corpus.kinds[k] + 1))
                base = np.log10((count[number] + 1) / (n + v + 1))
                starts = np.append(0, np.cumsum(sizes + 1)[:-1])
                sums = [np.add.reduceat(x, starts) for x in (count[number] > 0, base, p)]
                yield kit.record(out, [pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array([d["held_out"] for d in row["docs"]]), sizes + 1, sums[0].astype(np.int64), np.full(len(sizes), n), sums[1], sums[2]])

    return kit.mapped(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame) -> DataFrame:
    """Learns from documents whose id's crc32 modulo 7 is not 2."""
    return scores(docs.select("doc_id", "text"), kit.fold(F.col("doc_id"), 7) == 2)
