"""SimHash near-duplicates: fingerprints, links by pivot distance tables, groups."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kit
from .components import components

WORDS = 3
BITS = 3
SEED = 42
#: Reference fingerprints of the distance table.
PIVOTS = kit.mix(np.arange(1001, 1017, dtype=np.uint64))
#: Fingerprints that are compared with each other at once; a larger bucket is dealt out as pairs of tiles of this size.
TILE = 4096


# -- fingerprints ---------------------------------------------------------------------------------------------


def fingerprint(joined: bytes, starts: np.ndarray, ends: np.ndarray, words: int = WORDS) -> int:
    """Of the words of one text, joined by single blanks; starts and ends of the words in it."""
    from xxhash import xxh64_intdigest

    n = len(starts)
    if not n:
        return 0
    k = min(words, n)
    first, last = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    over, bits = len(first), np.zeros(64, np.int64)
    for a in range(0, over, 1 << 16):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(first[a : a + (1 << 16)], last[a : a + (1 << 16)], strict=True)], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > over, bitorder="little").tobytes(), "little")


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words lower-cased with one blank after each; their starts, ends and the word offsets of the texts."""
    low = kit.LOWER[data]
    starts, ends = kit.word_bounds(low, offsets, kit.NOT_BLANK)
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
    keep = np.repeat(starts - to, lengths + 1) + np.arange(len(out))
    blank = np.zeros(len(out), bool)
    blank[to + lengths] = True
    out[~blank] = low[keep[~blank]]
    return out.tobytes(), to, to + lengths, np.searchsorted(starts, offsets)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (any columns and text) without text but with `_fp`, the fingerprint as a signed long."""
    names = [n for n in docs.columns if n != "text"]
    schema = docs.select(*names, F.lit(0).cast("long").alias("_fp")).schema

    def run(batches, out):
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch):
                joined, starts, ends, bounds = joined_words(data, offsets)
                fps = np.array([fingerprint(joined, starts[a:b], ends[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
                yield kit.record(out, [*(rows.column(n) for n in names), fps.view(np.int64)])

    return kit.mapped(docs, run, schema)


# -- links ----------------------------------------------------------------------------------------------------


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to all pivots, one row a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def near_pairs(left: np.ndarray, right: np.ndarray | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `bits`: a pair whose pivot distances differ by more in any coordinate is discarded unseen.

    Rows are ordered by their distance to the first pivot, so each meets only a band of others. right None: left with itself.
    """
    other = left if right is None else right
    a_table, b_table = pivot_table(left), pivot_table(other)
    b_order = np.argsort(b_table[:, 0], kind="stable")
    band = b_table[b_order, 0].astype(np.int64)
    low = np.searchsorted(band, a_table[:, 0].astype(np.int64) - bits, "left")
    high = np.searchsorted(band, a_table[:, 0].astype(np.int64) + bits, "right")
    found_a, found_b = [], []
    step = max(1, (1 << 20) // max(1, len(other)))
    for s in range(0, len(left), step):
        counts = (high - low)[s : s + step]
        i = np.repeat(np.arange(s, s + len(counts)), counts)
        j = b_order[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[s : s + step], counts)]
        if right is None:
            i, j = i[i < j], j[i < j]
        for p in range(1, len(PIVOTS)):
            close = np.abs(a_table[i, p] - b_table[j, p]) <= bits
            i, j = i[close], j[close]
        close = np.bitwise_count(left[i] ^ other[j]) <= bits
        found_a.append(i[close])
        found_b.append(j[close])
    return np.concatenate(found_a or [np.empty(0, np.int64)]), np.concatenate(found_b or [np.empty(0, np.int64)])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links among n nodes, those that join parts not joined before."""
    parent = list(range(n))
    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append((x, y))
    return kept


def bucket_keys(fp, bits: int = BITS):
    """A fingerprint is cut into bits + 2 parts; for each pair of parts, a key of their bits and the pair's number.

    Fingerprints within `bits` agree on two parts at least, so they share a key.
    """
    n, keys = bits + 2, []
    parts = [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]
    for number, (p, q) in enumerate(combinations(parts, 2)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in (p, q))
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(signed).cast("long")), F.lit(number)))
    return F.array(*keys)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) for distinct fingerprints `_fp`: enough links within `bits` to join what all such links join.

    The keys of a fingerprint (ten for 3 bits) name the buckets. A bucket of over TILE fingerprints is dealt out as pairs of tiles, so no
    task holds more than two tiles, and each pair of tiles gives fewer links than it has fingerprints.
    """
    keys = prints.select("_fp", F.explode(bucket_keys(F.col("_fp"), bits)).alias("key"))
    busy = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "_k")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = keys.join(busy, F.col("key") == F.col("_k")).select("_fp", "key", tiles.alias("tiles"), F.pmod(F.xxhash64("_fp", F.lit(7)), tiles).cast("int").alias("mine"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "_fp", F.xxhash64("key", F.least("mine", "with"), F.greatest("mine", "with")).alias("cell"), ((F.col("mine") == F.col("with")).cast("int") * 2 + (F.col("mine") > F.col("with")).cast("int")).cast("byte").alias("side")
    )
    width = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.sparkSession.sparkContext.defaultParallelism)

    def join(batches, schema):

        def small(fps, cells, sides):
            # cells of a few rows, all at once: each row with the next, the one after, ...
            a, b, lag = [], [], 1
            while len(same := np.flatnonzero(cells[lag:] == cells[:-lag])):
                x, y = fps[same], fps[same + lag]
                near = (np.abs(pivot_table(x) - pivot_table(y)) <= bits).all(axis=1) & (np.bitwise_count(x ^ y) <= bits)
                a.append(x[near])
                b.append(y[near])
                lag += 1
            return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])

        def emit(cells, fps, sides):
            edge = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            sizes = np.diff(np.append(edge, len(cells)))
            few = np.repeat((sizes <= 8), sizes) & (sides == 2)
            x, y = small(fps[few], cells[few], sides[few])
            if len(x):
                yield kit.record(schema, [x.view(np.int64), y.view(np.int64)])
            for s, n in zip(edge, sizes, strict=True):
                f, side = fps[s : s + n], sides[s : s + n]
                if n <= 8 and (side == 2).all():
                    continue
                if side[0] == 2:
                    i, j = near_pairs(f, None, bits)
                    pairs = spanning(len(f), i, j)
                    u = f
                else:
                    l, r = f[side == 0], f[side == 1]
                    i, j = near_pairs(l, r, bits)
                    u = np.concatenate([l, r])
                    pairs = spanning(len(u), i, j + len(l))
                if pairs:
                    i, j = np.array(pairs).T
                    yield kit.record(schema, [u[i].view(np.int64), u[j].view(np.int64)])

        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8)]
        for batch in batches:
            new = (batch.column("cell").to_numpy(), batch.column("_fp").to_numpy().view(np.uint64), batch.column("side").to_numpy())
            held = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last cell may go on
            if whole:
                yield from emit(*(h[:whole] for h in held))
                held = [h[whole:] for h in held]
        if len(held[0]):
            yield from emit(*held)

    return kit.mapped(met.repartition(width, "cell").sortWithinPartitions("cell"), join, "a long, b long")


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint and component_id, one row for each row of docs (doc_id, text; other columns are left alone).

    Fingerprints link at `bits` or fewer differing bits.

    Only distinct fingerprints meet, each with its smallest doc_id; copies are never paired. Null, empty and word-less
    texts have fingerprint zero and are linked like any others; a text of fewer words than a shingle is one shingle;
    repeated rows share all results. A component made only of null ids has a null id. Texts of any length go whole; an empty
    table gives no rows.
    """
    prints = kit.stored(fingerprints(docs.select("doc_id", "text")), "prints")
    nodes = kit.stored(prints.groupBy("_fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("_fp"), bits))
    placed = nodes.join(roots, nodes["_fp"] == roots["node"], "left").select("_fp", "first", F.coalesce("root", "_fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = placed.join(smallest, "root").select(F.col("_fp").alias("_p"), "component_id")
    return prints.join(of_print, F.col("_fp") == F.col("_p")).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... and `_h`, a hash of the whole row, and its names; equal rows have equal hashes."""
    rows, names = kit.numbered(docs)
    cells = [F.col(c) for c in rows.columns]
    return rows.withColumn("_h", F.xxhash64(*cells, *(c.isNull() for c in cells))), names


def texts(rows: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, text and `_h` of keyed rows."""
    return rows.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"), "_h")


def one_of_each(rows: DataFrame, names: list[str], prints: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each group the row of the smallest (doc_id, `_h`), null ids last. prints: doc_id, `_h`, `_fp` of all rows; roots: (node, root) of linked prints."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("first")
    nodes = prints.groupBy("_fp").agg(first)
    firsts = nodes.join(roots, F.col("_fp") == F.col("node"), "left").groupBy(F.coalesce("root", "_fp").alias("_root")).agg(F.min("first").alias("first"))
    # rows that come more than once are rare: only they are brought together
    twice = prints.groupBy("_h").count().where("count > 1").select(F.col("_h").alias("_twice"))
    keep = kit.stored(firsts.select(F.col("first._h").alias("_keep")).join(twice, F.col("_keep") == F.col("_twice"), "left").select("_keep", F.col("_twice").isNotNull().alias("_many")), "keep", keep=True)
    kept = rows.join(keep, F.col("_h") == F.col("_keep"))
    cells = [f"c{i}" for i in range(len(names))]
    once = kept.where("not _many").select(*cells)
    rest = kept.where("_many").groupBy("_h").agg(F.min(F.struct(*cells)).alias("_row")).select("_row.*")
    return kit.named(once.union(rest), names)


def deduplicated(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with the columns of docs; repeated rows of it become one.

    Groups are told apart by their fingerprints, not by ids: each keeps one row, also where ids are null or repeated.
    """
    rows, names = keyed(docs)
    prints = kit.stored(fingerprints(texts(rows, names)), "prints")
    return one_of_each(rows, names, prints, components(links(prints.select("_fp").distinct(), bits)))
