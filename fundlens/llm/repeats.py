"""Removal of repeated 100-byte strings by suffix ranks: distributed prefix doubling over synchronising positions."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kit

LENGTH = 100
#: Bytes of a first rank. Every LENGTH-byte string holds at least one chosen position with all bytes of its rank.
NAME = 48
SPAN = LENGTH - NAME + 1
BLOCK_BYTES = 8 << 20
#: Bytes of a text that are ranked at once.
PIECE = 2 << 20
#: Positions of one task that meet before they are sent.
HELD = 1_000_000
ROW_BITS = 24
REP, MARKER, REPEATED, OPEN = 0, 1, 2, 3


# -- ranks of one text ----------------------------------------------------------------------------------------


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for all whole windows, in log2(width) steps."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[:-rest], x[rest:]) if rest else x


class Ranks:
    """Of a piece of LENGTH bytes or more. Equal strings have equal ranks: a rank is a 64-bit name of what it covers.

    A string of LENGTH bytes stands under the chosen position whose first rank is the lowest that starts in it (the
    leftmost among equals), so equal strings stand under equal ranks at equal offsets. For each chosen position: `name`,
    and `first` to `last`, the starts of the strings under it.
    """

    def __init__(self, data: np.ndarray):
        sums = kit.prefix_hashes(data)
        at = np.arange(len(data) - NAME + 1)
        self.h = h = kit.slice_hashes(sums, at, at + NAME)
        lowest = _sliding(h, SPAN, np.minimum)
        n = len(lowest)
        pad = np.zeros(SPAN - 1, np.uint64)
        ranked = np.flatnonzero(_sliding(np.concatenate([pad, lowest, pad]), SPAN, np.maximum) == h)
        step = np.searchsorted(ranked, np.arange(n))
        pick = ranked[step]
        wrong = np.flatnonzero(h[pick] != lowest)
        while len(wrong):
            step[wrong] += 1
            pick[wrong] = ranked[step[wrong]]
            wrong = wrong[h[pick[wrong]] != lowest[wrong]]
        self.first = np.flatnonzero(np.append(True, pick[1:] != pick[:-1]))
        self.last = np.append(self.first[1:], n) - 1
        place = pick[self.first]
        self.name = h[place]
        #: a name of all bytes of the strings under a position, and of where in them it lies
        self.context = kit.mix(kit.slice_hashes(sums, self.first, self.last + LENGTH) + (place - self.first).astype(np.uint64))

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """Ranks of LENGTH bytes, by doubling: pairs of ranks at growing offsets (NAME, then what is left)."""
        h, two = self.h, 2 * NAME
        pair = lambda a, b: kit.mix(kit.mix(a) + b * np.uint64(3))
        double = lambda p: pair(h[p], h[p + NAME])
        return pair(double(starts), double(starts + LENGTH - two))


def pieces(data: np.ndarray, size: int):
    """(offset, piece): a text's pieces overlap so that each string of LENGTH bytes is whole in exactly one."""
    for a in range(0, len(data) - LENGTH + 1, size):
        yield a, data[a : a + size + LENGTH - 1]


# -- blocks ---------------------------------------------------------------------------------------------------


def blocks(docs: DataFrame) -> DataFrame:
    """Whole documents in blocks, as a table in the shared folder that is bucketed by block: later joins leave texts in place."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches, out):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some, data, offsets in kit.chunks(batch, "text", BLOCK_BYTES):
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("doc_id"))
                ends = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), pa.array(offsets[1:], pa.int64()))
                yield kit.record(out, [[part << 12 | number], ids, ends, [data.tobytes()]])
                number += 1

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    name = f"blocks_{uuid.uuid4().hex}"
    made = kit.mapped(rows, run, "block long, ids array<long>, ends array<long>, data binary")
    made.write.bucketBy(buckets, "block").option("path", kit.scratch_path(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _texts(row) -> list[tuple[int | None, np.ndarray]]:
    data, ends = np.frombuffer(row["data"], np.uint8), row["ends"]
    return [(d, data[a:b]) for d, a, b in zip(row["ids"], [0, *ends[:-1]], ends, strict=True)]


def _rows(batch, *extra):
    for i in range(batch.num_rows):
        yield {k: batch.column(k)[i].as_py() for k in ("block", "ids", "ends", "data")} | {k: batch.column(k)[i].values for k in extra}


def _firsts(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then doc and start; and for each ordered row whether it comes strictly after the first of its keys."""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[1:] = ~new[1:]
    at = np.flatnonzero(new)
    head = np.repeat(at, np.diff(np.append(at, len(order))))
    later = (doc[order] != doc[order][head]) | (start[order] != start[order][head])
    return order, later


_NO_ID = -(1 << 63)


# -- rounds ---------------------------------------------------------------------------------------------------


def first_round(table: DataFrame) -> DataFrame:
    """key, context, doc, ref, start, kind: position and rank pairs that have to meet.

    Inside a task, a position with the context of an earlier one is REPEATED already: it travels under its document's
    key. A name with several contexts in a task would crowd one key: only a MARKER goes there, and its positions go to
    keys of name and context (OPEN).
    """

    def run(batches, out):
        held, n = [], 0

        def send():
            name, context, doc, ref, start = (np.concatenate([h[k] for h in held]) for k in range(5))
            order, later = _firsts([name, context], doc, start)
            name, context, doc, ref, start = name[order], context[order], doc[order], ref[order], start[order]
            kind = np.where(later, REPEATED, REP).astype(np.int8)
            new = np.append(True, name[1:] != name[:-1])
            group = np.cumsum(new) - 1
            other = np.zeros(group[-1] + 1, bool)
            np.logical_or.at(other, group[1:], (context[1:] != context[:-1]) & ~new[1:])
            several = other[group]
            kind[several & ~later] = OPEN
            key = np.where(several, kit.mix(name + context), name)
            key = np.where(later, kit.mix(ref.astype(np.uint64)), key)
            mark = np.flatnonzero(new & several)
            # 48 bits tell contexts of a name apart (one a task); other keys hold the context already
            context = np.where(kind == REP, context & np.uint64((1 << 48) - 1), np.uint64(0))
            in_text = np.lexsort((start, ref))  # neighbours in a text differ little, which the shuffle compresses
            yield kit.record(out, [x[in_text].view(np.int64) if x.dtype == np.uint64 else x[in_text] for x in (key, context, doc, ref, start, kind)])
            if len(mark):
                none = np.zeros(len(mark), np.int64)
                yield kit.record(out, [name[mark].view(np.int64), none, none, none, none, np.full(len(mark), MARKER, np.int8)])

        for batch in batches:
            for row in _rows(batch):
                for i, (doc, text) in enumerate(_texts(row)):
                    for a, piece in pieces(text, PIECE):
                        r = Ranks(piece)
                        m = len(r.first)
                        held.append((r.name, r.context, np.full(m, _NO_ID if doc is None else doc), np.full(m, row["block"] << ROW_BITS | i), r.first + a))
                        n += m
                        if n >= HELD:
                            yield from send()
                            held, n = [], 0
        if n:
            yield from send()

    return kit.mapped(table.select("block", "ids", "ends", "data"), run, "key long, context long, doc long, ref long, start long, kind byte")


def _by_key(df: DataFrame, key: str, *then: str) -> DataFrame:
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(width, key).sortWithinPartitions(key, *then)


def _whole_groups(batches, key: str):
    """Batches cut so that rows of a key stay together, as numpy columns; a key that outgrows a batch is held whole only while its rows come."""
    held = None
    for batch in batches:
        new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
        cut = int(np.searchsorted(held[key], held[key][-1])) if len(held[key]) else 0
        if cut:
            yield {n: v[:cut] for n, v in held.items()}
            held = {n: v[cut:] for n, v in held.items()}
    if held is not None and len(held[key]):
        yield held


def second_round(pairs: DataFrame) -> DataFrame:
    """block, ref, start, kind: REPEATED positions, and OPEN ones, whose name occurs in other contexts. Unique ones are gone."""

    def run(batches, out):
        for g in _whole_groups(batches, "key"):
            key, kind = g["key"], g["kind"]
            new = np.append(True, (key[1:] != key[:-1]))
            group = np.cumsum(new) - 1
            n = group[-1] + 1
            # rows that compete by context: neither markers nor settled already
            live = np.flatnonzero((kind == REP) | (kind == OPEN))
            order, later = _firsts([key[live], g["context"][live]], g["doc"][live], g["start"][live])
            result = kind.copy()
            result[live[order[later]]] = REPEATED
            # a name with a marker, or with several contexts, is open
            opened = np.zeros(n, bool)
            opened[group[(kind == MARKER) | (kind == OPEN)]] = True
            lg, lc = group[live], g["context"][live]
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(low, lg, lc)
            np.maximum.at(high, lg, lc)
            opened |= low < high
            result[(result == REP) & opened[group]] = OPEN
            keep = np.flatnonzero((result == REPEATED) | (result == OPEN))
            if len(keep):
                yield kit.record(out, [g["ref"][keep] >> ROW_BITS, g["ref"][keep], g["start"][keep], result[keep]])

    return kit.mapped(_by_key(pairs, "key"), run, "block long, ref long, start long, kind byte")


def third_round(table: DataFrame, decided: DataFrame) -> DataFrame:
    """rank, doc, ref, start, end: strings under OPEN positions with their LENGTH-byte ranks; or settled spans (end > 0)."""
    # both sides grow with the corpus; the bucketed table stays where it is
    per_block = decided.groupBy("block").agg(F.collect_list(F.struct("ref", "start", "kind")).alias("found")).withColumnRenamed("block", "b")
    joined = table.join(per_block.hint("merge"), F.col("block") == F.col("b")).select("block", "ids", "ends", "data", "found")

    def run(batches, out):
        for batch in batches:
            for row in _rows(batch, "found"):
                ref, start, kind = (row["found"].field(k).to_numpy() for k in ("ref", "start", "kind"))
                order = np.lexsort((start, ref))
                ref, start, kind = ref[order], start[order], kind[order]
                edges = np.append(np.flatnonzero(np.append(True, ref[1:] != ref[:-1])), len(ref))
                texts = _texts(row)
                spans, strings = [], []
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    doc, text = texts[int(ref[s]) & (1 << ROW_BITS) - 1]
                    for a, piece in pieces(text, PIECE):
                        lo, hi = s + np.searchsorted(start[s:e], [a, a + PIECE])
                        if lo == hi:
                            continue
                        r = Ranks(piece)
                        i = np.searchsorted(r.first, start[lo:hi] - a)
                        settled, opened = i[kind[lo:hi] == REPEATED], i[kind[lo:hi] == OPEN]
                        if len(settled):
                            spans.append((np.full(len(settled), ref[s]), r.first[settled] + a, r.last[settled] + LENGTH + a))
                        if len(opened):
                            at = kit.ragged(r.first[opened], r.last[opened] - r.first[opened] + 1)
                            strings.append((r.strings(at), np.full(len(at), _NO_ID if doc is None else doc), np.full(len(at), ref[s]), at + a))
                if strings:
                    rank, doc, of, at = (np.concatenate(x) for x in zip(*strings, strict=True))
                    order, later = _firsts([rank], doc, at)
                    gone, stay = order[later], np.sort(order[~later])
                    spans.append((of[gone], at[gone], at[gone] + LENGTH))
                    yield kit.record(out, [rank[stay].view(np.int64), doc[stay], of[stay], at[stay], np.zeros(len(stay), np.int64)])
                if spans:
                    of, a, b = _union(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                    yield kit.record(out, [kit.mix(of.astype(np.uint64)).view(np.int64), np.zeros(len(of), np.int64), of, a, b])

    return kit.mapped(joined, run, "rank long, doc long, ref long, start long, end long")


def _union(ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each ref joined where they touch or overlap, in order."""
    order = np.lexsort((start, ref))
    ref, start, end = ref[order], start[order], end[order]
    group = np.cumsum(np.append(False, ref[1:] != ref[:-1]))
    # running ends per ref: offset groups so that one running maximum serves all
    base = group * (int(end.max()) + 1 if len(end) else 1)
    reach = np.maximum.accumulate(end + base)
    new = np.append(True, (start[1:] + base[1:] > reach[:-1]) | (group[1:] != group[:-1]))
    at = np.flatnonzero(new)
    return ref[at], start[at], (reach - base)[np.append(at[1:], len(ref)) - 1]


def removed(strings: DataFrame) -> DataFrame:
    """block, ref, start, end of what goes: settled spans, and strings whose rank occurs earlier."""

    def run(batches, out):
        for g in _whole_groups(batches, "rank"):
            settled = g["end"] > 0
            live = np.flatnonzero(~settled)
            order, later = _firsts([g["rank"][live]], g["doc"][live], g["start"][live])
            gone = live[order[later]]
            ref = np.concatenate([g["ref"][settled], g["ref"][gone]])
            if len(ref):
                start = np.concatenate([g["start"][settled], g["start"][gone]])
                end = np.concatenate([g["end"][settled], g["start"][gone] + LENGTH])
                ref, start, end = _union(ref, start, end)
                yield kit.record(out, [ref >> ROW_BITS, ref, start, end])

    return kit.mapped(_by_key(strings, "rank"), run, "block long, ref long, start long, end long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left, bytes), n_bytes, spans (first byte, length), one row for each row of docs (doc_id, text).

    A byte goes if a LENGTH-byte string over it also starts earlier: in a smaller doc_id, or in the same document. Rounds:
    positions with NAME-byte ranks are sorted by rank in Spark and leave when unique; those with a whole context seen
    earlier are settled; the strings of the others get LENGTH-byte ranks from pairs of ranks at growing offsets and are
    sorted once more. Repeats within a task are settled before anything is sent, so a passage that all documents share
    is sent once a task. Null text is empty; shorter texts lose nothing; a null id is the smallest; rows that share an
    id count as one document of several texts, where strings at the same start do not remove each other.
    """
    table = blocks(docs)
    gone = removed(third_round(table, second_round(first_round(table))))
    per_block = gone.groupBy("block").agg(F.collect_list(F.struct("ref", "start", "end")).alias("found")).withColumnRenamed("block", "b")
    joined = table.join(per_block.hint("merge"), F.col("block") == F.col("b"), "left").select("block", "ids", "ends", "data", "found")

    def run(batches, out):
        for batch in batches:
            for row in _rows(batch, "found"):
                texts, at = _texts(row), {}
                if row["found"] is not None and len(row["found"]):
                    ref, start, end = _union(*(row["found"].field(k).to_numpy() for k in ("ref", "start", "end")))
                    edges = np.append(np.flatnonzero(np.append(True, ref[1:] != ref[:-1])), len(ref))
                    at = {int(ref[s]) & (1 << ROW_BITS) - 1: (start[s:e], end[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)}
                kept, spans = [], []
                for i, (_, text) in enumerate(texts):
                    starts, ends = at.get(i, ((), ()))
                    stay = np.ones(len(text), bool)
                    for a, b in zip(starts, ends, strict=True):
                        stay[a:b] = False
                    kept.append(text[stay].tobytes())
                    spans.append([{"first": int(a), "bytes": int(b - a)} for a, b in zip(starts, ends, strict=True)])
                yield kit.record(out, [pa.array([d for d, _ in texts], pa.int64()), pa.array(kept, pa.binary()), np.array([len(t) for _, t in texts], np.int64), pa.array(spans, out.field("spans").type)])

    return kit.mapped(joined, run, "doc_id long, text binary, n_bytes long, spans array<struct<first:long,bytes:long>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = deduplicated(docs.select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
