"""Near-duplicates by word shingles: SimHash links checked by the shingles, and all other pairs of similarity 0.8 or more by prefixes of their rarest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kit, simhash
from .components import components

WORDS = 5
#: Least Jaccard similarity of linked texts, as a fraction.
NUM, DEN = 4, 5
#: Texts whose shingles are counted to tell common ones, in expectation, and how many common ones are kept. They set an order, not the result.
SAMPLE_TEXTS = 20_000
COMMON = 200_000
COMMON_FROM = 4
#: Sets of one shingle beyond which it goes to the end of the order; sets compared at once, and pairs of one set per task.
HOT = 1024
TILE = 4096
SPREAD = 4096
#: Shingles in which a set looks for the likeliest set of another part.
SEEKS = 32
#: Bits of the map of needed sets, and longs of the map that each set has of its own shingles.
BITS = 1 << 23
LONGS = 8
#: Bits of a set's parity map: twice its shingles up to the first number, half of them up to the second. They set the cost, not the result.
PARITY = (1 << 11, 1 << 13)
#: Different pairs that a task gathers before it gives them.
GATHERED = 1 << 20
#: Bytes of a shingle's hash by which two sets are compared.
BYTES = 6
#: Sets that a task remembers to have given.
REMEMBERED = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words is one shingle."""
    joined, starts, ends, bounds = simhash.joined_words(data, offsets)
    sizes = np.diff(bounds)
    over = np.where(sizes > 0, np.maximum(sizes - words + 1, 1), 0)
    first = kit.ragged(bounds[:-1], over)
    last = first + np.repeat(np.minimum(sizes, words) - 1, over)
    h = kit.spans_hashed(np.frombuffer(joined, np.uint8), starts[first], ends[last]).view(np.int64)
    cuts = np.append(0, np.cumsum(over))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def bit_map(s: np.ndarray) -> np.ndarray:
    """LONGS longs with a bit set for each shingle: shingles whose bit the other map lacks are not in the other set."""
    bits = np.zeros(64 * LONGS, np.uint8)
    bits[(kit.mix(s.view(np.uint64)) % np.uint64(64 * LONGS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def parity_map(s: np.ndarray) -> np.ndarray:
    """Longs in which each shingle flips a bit: where two maps differ, a shingle at least is in one set only.

    Maps are a power of two long, so a longer one folds into a shorter one. Unlike bit_map they still tell sets of very many shingles apart.
    """
    over = lambda x: 1 << max(x - 1, 0).bit_length()
    bits = max(64 * LONGS, min(PARITY[0], over(2 * len(s))), min(PARITY[1], over(len(s) // 2)))
    flips = np.bincount((kit.mix(s.view(np.uint64)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if set in over half of its hashes; the empty set has 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.int64)[0])


def packed(s: np.ndarray) -> bytes:
    """The set by the low BYTES bytes of its hashes, in their order.

    Two different shingles of a pair of sets of n and m look alike with a chance of n * m / 2**48.
    """
    return np.unique(s & ((1 << 8 * BYTES) - 1)).view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(c: bytes) -> np.ndarray:
    out = np.zeros((len(c) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(c, np.uint8).reshape(-1, BYTES)
    return out.view(np.int64)[:, 0]


#: What sets() may tell of a set: its hashes, those packed, or its size followed by its map, its fingerprint and its parity map.
FORMS = {"s": (None, "array<long>"), "c": (packed, "binary"), "m": (lambda s: np.concatenate([[len(s)], bit_map(s), [fingerprint(s)], parity_map(s)]), "array<long>")}


def sets(texts: DataFrame, form: str = "s") -> DataFrame:
    """doc_id, `_h`, `_fp` (a hash of the text's shingle set) and the set in one of FORMS, for doc_id, text and `_h`; the set is null where the task gave the same before.

    Nothing of it is stored: shingles take more room than the texts, so each use makes them anew.
    """
    from xxhash import xxh64_intdigest

    make, kind = FORMS[form]
    schema = texts.select("doc_id", "_h", F.lit(0).cast("long").alias("_fp"), F.lit(None).cast(kind).alias(form)).schema

    def run(batches, out):
        seen: set[int] = set()
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch):
                found = shingle_sets(data, offsets)
                names = [xxh64_intdigest(x.tobytes(), 42) for x in found]
                new = [not (k in seen or seen.add(k)) for k in names]
                some = pa.array([(make(x) if make else x) if n else None for x, n in zip(found, new, strict=True)], out.field(form).type)
                yield kit.record(out, [rows.column("doc_id"), rows.column("_h"), np.array(names, np.uint64).view(np.int64), some])
                if len(seen) > REMEMBERED:
                    seen.clear()

    return kit.mapped(texts, run, schema)


def common(one: DataFrame, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and in how many. They set an order, not the result. n: how many sets there are."""
    n = max(one.count() if n is None else n, 1)
    some = one.where(kit.share(F.col("_fp"), 5) * n < SAMPLE_TEXTS).dropDuplicates(["_fp"])
    top = some.select(F.explode("s").alias("t")).groupBy("t").count().where(F.col("count") >= COMMON_FROM).orderBy(F.desc("count"), "t").limit(COMMON).toArrow()
    return ordered(top.column("t").to_numpy(), top.column("count").to_numpy())


def ordered(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(t)
    return t[order], c[order]


def prefix(s: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare before common: two sets of similarity NUM / DEN or more share one of them.

    Such sets share NUM / DEN of the larger one, so the first shared shingle in any order of all shingles lies before that many last ones.
    """
    keep = len(s) - -(-NUM * len(s) // DEN) + 1
    often = np.zeros(len(s), np.int64)
    if len(known):
        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
        often = np.where(known[i] == s, counts[i], 0)
    return s[np.argsort(often, kind="stable")[:keep]]


def fits(n, i, m, j):
    """Whether sets of n and m shingles whose first shared shingle is number i of one and j of the other can be that similar.

    Sizes must agree, and what follows that shingle must suffice for the overlap that the similarity asks for. Columns or arrays.
    """
    least = F.least if hasattr(n, "alias") else np.minimum
    greatest = F.greatest if hasattr(n, "alias") else np.maximum
    return (least(n, m) * DEN >= greatest(n, m) * NUM) & (least(n - i, m - j) * (NUM + DEN) >= (n + m) * NUM)


def shared(t: np.ndarray, f: np.ndarray, w: np.ndarray, held: list) -> np.ndarray | None:
    """Rows (t, f, w, p, pw) of the shingles that two different sets hold, from rows in order of (t, f).

    held: the first row of the last shingle so far, whether it was given, and its last set. Each row comes with the first of its shingle.
    """
    if held:
        (t0, f0, w0), given, last = held
        new = ~((t == t0) & (f == last))
        t, f, w = t[new], f[new], w[new]
        if not len(t):
            return None
        if t[0] == t0:
            t, f, w = np.append(t0, t), np.append(f0, f), np.append(w0, w)
        else:
            given = False
    else:
        given = False
        if not len(t):
            return None
    fresh = np.append(True, (t[1:] != t[:-1]) | (f[1:] != f[:-1]))
    t, f, w = t[fresh], f[fresh], w[fresh]
    edge = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    sizes = np.diff(np.append(edge, len(t)))
    emit = np.repeat(sizes > 1, sizes)
    if given:
        emit[0] = False
    first = np.repeat(edge, sizes)
    held[:] = [(t[edge[-1]], f[edge[-1]], w[edge[-1]]), bool(sizes[-1] > 1 or (given and len(edge) == 1)), f[-1]]
    return np.array([t[emit], f[emit], w[emit], f[first[emit]], w[first[emit]]])


def cells(one: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """t, `_fp`, w, p, pw: the prefix shingles that at least two sets have, with those sets and one (p) of them.

    w holds a set's size and the place of the shingle in it. One exchange by shingle, sorted; shingles of one set, which
    are most, end there, and a shingle of any number of sets is read in a stream.
    """
    sent = one.sparkSession.sparkContext.broadcast(order)

    def run(batches, out):
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            names, column = batch.column("_fp").to_numpy(), batch.column("s")
            lists = [column[i].values.to_numpy() for i in range(batch.num_rows)]
            parts = [prefix(s, *sent.value) if len(s) else s for s in lists]
            k = np.array([len(x) for x in parts], np.int64)
            place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            yield kit.record(out, [np.concatenate([*parts, np.empty(0, np.int64)]), np.repeat(names, k), (np.repeat([len(s) for s in lists], k).astype(np.int64) << 32) | place])

    def scan(batches, out):
        held: list = []
        for batch in batches:
            found = shared(*(batch.column(c).to_numpy() for c in ("t", "_fp", "w")), held)
            if found is not None and found.shape[1]:
                yield kit.record(out, list(found))

    rows = kit.mapped(one.select("_fp", "s"), run, "t long, _fp long, w long")
    return kit.mapped(rows.repartition(kit.width(one.sparkSession), "t").sortWithinPartitions("t", "_fp"), scan, "t long, _fp long, w long, p long, pw long")


def met(one: DataFrame, n: int | None = None) -> DataFrame:
    """The cells. Where shingles turn out to be held by many sets although no sample showed it, they go to the end of the order and the sets meet anew."""
    order = common(one, n)
    found = kit.stored(cells(one, order), "cells")
    hot = found.groupBy("t").count().where(F.col("count") > HOT).orderBy(F.desc("count"), "t").limit(COMMON).toArrow()
    t, c = hot.column("t").to_numpy(), hot.column("count").to_numpy()
    new = ~np.isin(t, order[0])
    if not new.any():
        return found
    return kit.stored(cells(one, ordered(np.append(order[0], t[new]), np.append(order[1], c[new] + order[1].max(initial=0)))), "cells")


def wanted(one: DataFrame, needed: DataFrame) -> DataFrame:
    """The sets of the needed prints (`_n`), and a few more: the others are mostly told apart by a bit map of fixed size before they are shuffled.

    The map has BITS bits however many prints are needed, so it may be broadcast; the more bits are set, the less it spares.
    """
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(9)), F.lit(BITS))
    mine = "shiftleft(1L, int(_b & 63))"
    words = needed.select(bit("_n").alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.expr(f"bit_or({mine})").alias("_bits"))
    return one.withColumn("_b", bit("_fp")).join(F.broadcast(words), F.shiftright("_b", 6) == F.col("_w")).where(f"(_bits & {mine}) <> 0").select("_fp", "c")


def possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), once each, whose sizes and maps allow the similarity. maps: `_fp`, m.

    Each bit that one map has and the other lacks is a shingle at least that they do not share, so no pair of the similarity goes.
    """
    out = pairs.distinct()
    for end, name in (("a", "x"), ("b", "y")):
        out = out.join(maps.select(F.col("_fp").alias("_f"), F.slice("m", 1, LONGS + 1).alias(name)), F.col(end) == F.col("_f")).drop("_f")
    alone = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(1, LONGS + 1)), F.lit(0))
    n, m = F.col("x")[0], F.col("y")[0]
    return out.where(F.least(n - alone("x", "y"), m - alone("y", "x")) * (NUM + DEN) >= (n + m) * NUM).select("a", "b")


def compared(batches, out):
    """(a, b) of the pairs of the similarity, from rows (a, part, b, c) in that order; the row without b has the set of a and comes first."""
    head = None
    for batch in batches:
        found = []
        for a, b, c in zip(*(batch.column(x) for x in ("a", "b", "c")), strict=True):
            mine = unpacked(c.as_buffer())
            if not b.is_valid:
                head = mine
            elif len(np.intersect1d(head, mine, assume_unique=True)) * (NUM + DEN) >= (len(head) + len(mine)) * NUM:
                found.append((a.as_py(), b.as_py()))
        yield kit.record(out, list(np.array(found, np.int64).reshape(-1, 2).T))


def verified(pairs: DataFrame, one: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets have the similarity, by the sets themselves. one: `_fp`, c.

    The set of b goes to that of a, one for each pair. A set a of many pairs is laid out several times, so several tasks
    compare it; a task holds the set of one a and reads the others in a stream.
    """
    pairs = kit.stored(possible(pairs, maps), "pairs")
    heads = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / SPREAD).cast("int").alias("parts"))
    busy = heads.where("parts > 1").select(F.col("a").alias("_a"), "parts")
    ends = heads.select(F.col("a").alias("_n"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b")).union(
        pairs.join(busy, F.col("a") == F.col("_a"), "left").select(F.col("b").alias("_n"), "a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "b"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("_n")).distinct()
    nodes = wanted(one, needed).groupBy("_fp").agg(F.first("c").alias("c"))
    laid = ends.join(nodes.hint("merge"), F.col("_n") == F.col("_fp")).select("a", "part", "b", "c")
    return kit.stored(kit.mapped(laid.repartition(kit.width(one.sparkSession), "a", "part").sortWithinPartitions("a", "part", "b"), compared, "a long, b long"), "similar")


def unjoined(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """t, `_fp`, w, r (what the set is joined to) and c (sets of the shingle): rows whose shingle has sets not joined with each other."""
    placed = kit.stored(rows.join(components(joined), F.col("_fp") == F.col("node"), "left").select("t", "_fp", "w", F.coalesce("root", "_fp").alias("r")), "placed")
    busy = placed.groupBy(F.col("t").alias("_t")).agg(F.count("*").alias("c"), F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high")
    return kit.stored(placed.join(busy, F.col("t") == F.col("_t")).select("t", "_fp", "w", "r", "c"), "unjoined")


def possible_pairs(w: np.ndarray, r: np.ndarray, side: np.ndarray, seek: np.ndarray, alike) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of a cell, ordered by size, that are not joined yet and that sizes, places and maps (`alike`) allow to be alike; one of each seeks."""
    n, i = w >> 32, w & 0xFFFFFFFF
    to = np.searchsorted(n * NUM, n * DEN, "right")  # sizes beyond are too large for the smaller one
    step = max(1, (1 << 17) // max(len(w), 1))
    for at in range(0, len(w), step):
        a = np.arange(at, min(at + step, len(w)))
        sizes = np.maximum(to[a] - a - 1, 0)
        x = np.repeat(a, sizes)
        y = kit.ragged(a + 1, sizes)
        good = (r[x] != r[y]) & (seek[x] | seek[y]) & ((side[x] == 2) | (side[x] != side[y])) & fits(n[x], i[x], n[y], i[y])
        x, y = x[good], y[good]
        good = alike(n, x, y) if len(x) else good[:0]
        if good.any():
            yield x[good], y[good]


def alike_by_map(m: np.ndarray):
    """Whether bit maps, the rows of m, allow rows x and y of n shingles to be alike."""

    def alike(n, x, y):
        alone = lambda p, q: np.bitwise_count(m[p] & ~m[q]).sum(axis=1, dtype=np.int64)
        return np.minimum(n[x] - alone(x, y), n[y] - alone(y, x)) * (NUM + DEN) >= (n[x] + n[y]) * NUM

    return alike


def alike_by_parity(m: np.ndarray):
    """Whether parity maps, an array each, allow rows x and y of n shingles to be alike: such sets differ in few shingles."""
    longs = np.fromiter(map(len, m), np.int64, len(m))
    place = np.empty(len(m), np.int64)
    table = {}
    for k in np.unique(longs):
        mine = np.flatnonzero(longs == k)
        place[mine] = np.arange(len(mine))
        table[int(k)] = np.stack(m[mine]).view(np.uint64)

    def alike(n, x, y):
        out = np.empty(len(x), bool)
        kinds = longs[x] << 32 | longs[y]
        for kind in np.unique(kinds):
            here = np.flatnonzero(kinds == kind)
            p, q = int(kind) >> 32, int(kind) & 0xFFFFFFFF
            width, step = min(p, q), max(1, (1 << 20) // max(p, q))
            for at in range(0, len(here), step):
                some = here[at : at + step]
                one, two = (np.bitwise_xor.reduce(table[k][place[z[some]]].reshape(len(some), k // width, width), axis=1) for k, z in ((p, x), (q, y)))
                out[some] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) * (NUM + DEN) <= (n[x[some]] + n[y[some]]) * (DEN - NUM)
        return out

    return alike


class Nearest:
    """Of the pairs of a cell, for each row the row whose map is most like its own, and of those about as alike as NUM / DEN the one of the lowest part."""

    def __init__(self, r: np.ndarray, m: np.ndarray):
        self.m, self.part = m, (kit.mix(r.view(np.uint64)) >> np.uint64(1)).view(np.int64)
        self.like, self.low = np.full(len(r), -1.0), np.full(len(r), np.iinfo(np.int64).max)
        self.to, self.under = np.full(len(r), -1), np.full(len(r), -1)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        both, any_ = (np.bitwise_count(f(self.m[x], self.m[y])).sum(axis=1, dtype=np.int64) for f in (np.bitwise_and, np.bitwise_or))
        like, alike = both / np.maximum(any_, 1), both * DEN >= any_ * NUM
        for p, q in ((x, y), (y, x)):
            np.maximum.at(self.like, p, like)
            top = like >= self.like[p]
            self.to[p[top]] = q[top]
            p, q = p[alike], q[alike]
            np.minimum.at(self.low, p, self.part[q])
            top = self.part[q] <= self.low[p]
            self.under[p[top]] = q[top]

    def found(self, f: np.ndarray, seek: np.ndarray) -> list[np.ndarray]:
        """a, b, how alike their maps are and the part of b; the part is the highest number unless it is the lowest one that is alike."""
        one, two = np.flatnonzero(seek & (self.to >= 0)), np.flatnonzero(seek & (self.under >= 0))
        a, b = np.concatenate([one, two]), np.concatenate([self.to[one], self.under[two]])
        return [f[a], f[b], np.concatenate([self.like[one], np.zeros(len(two))]), np.concatenate([np.full(len(one), np.iinfo(np.int64).max), self.low[two]])]


def meetings(open_rows: DataFrame, maps: DataFrame, seeks: int | None = None) -> DataFrame:
    """(a, b) of the sets that share a shingle, are not joined yet and by sizes, places and maps can be alike.

    open_rows: as from unjoined. maps: `_fp`, m; the parity maps (with seeks, the bit maps) go with the rows, so pairs are
    discarded where the sets meet and are never written; a task gives a pair once. Sets of a shingle of over TILE are dealt
    out as pairs of tiles. With seeks, each set looks in that many of its shingles only and takes the likeliest set it
    meets and one of the lowest part: at most two pairs a set.
    """
    spark = open_rows.sparkSession
    rows = open_rows
    seek = F.lit(True)
    if seeks:
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("_fp").orderBy(F.xxhash64("t", "_fp"), "t")))
        seek = F.col("turn") <= seeks
    tiles = F.ceil(F.col("c") / TILE).cast("int")
    told = F.slice("m", 2, LONGS) if seeks else F.slice("m", F.lit(LONGS + 3), F.size("m") - (LONGS + 2))
    mapped_rows = rows.join(maps.select(F.col("_fp").alias("_m"), told.alias("m")).hint("merge"), F.col("_fp") == F.col("_m")).select("t", "_fp", "w", "r", "m", seek.alias("seek"), tiles.alias("tiles"), F.pmod(F.xxhash64("_fp", F.lit(7)), tiles).cast("int").alias("mine"))
    dealt = mapped_rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.xxhash64("t", F.least("mine", "with"), F.greatest("mine", "with")).alias("cell"), "_fp", "w", "r", ((F.col("mine") == F.col("with")).cast("int") * 2 + (F.col("mine") > F.col("with")).cast("int")).cast("byte").alias("side"), "seek", "m"
    )

    def pairs(cell: list[np.ndarray]):
        f, w, r, side, seek, m = cell
        order = np.argsort(w >> 32, kind="stable")
        f, w, r, side, seek, m = f[order], w[order], r[order], side[order], seek[order], m[order]
        near = Nearest(r, m) if seeks else None
        for x, y in possible_pairs(w, r, side, seek, alike_by_map(m) if seeks else alike_by_parity(m)):
            if near:
                near.add(x, y)
            else:
                yield np.minimum(f[x], f[y]), np.maximum(f[x], f[y])
        if near and (near.to >= 0).any():
            yield near.found(f, seek)

    def run(batches, out):
        held: list = []
        gathered, n = [np.empty((2, 0), np.int64)], 0

        def whole(parts):
            nonlocal gathered, n
            edge = np.flatnonzero(np.append(True, parts[0][1:] != parts[0][:-1]))
            for s, e in zip(edge, np.append(edge[1:], len(parts[0])), strict=True):
                for found in pairs([p[s:e] for p in parts[1:]]):
                    if seeks:
                        yield kit.record(out, list(found))
                        continue
                    gathered.append(np.array(found))
                    n += len(found[0])
                    if n > GATHERED:
                        gathered = [np.unique(np.concatenate(gathered, axis=1), axis=1)]
                        n = gathered[0].shape[1]
                        if 2 * n > GATHERED:
                            yield kit.record(out, list(gathered.pop()))
                            gathered, n = [np.empty((2, 0), np.int64)], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "_fp", "w", "r", "side", "seek")]
            new.append(batch.column("m").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) if seeks else batch.column("m").to_numpy(zero_copy_only=False))
            held = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)] if held else new
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
            if cut:
                yield from whole([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held:
            yield from whole(held)
        if n:
            yield kit.record(out, list(np.unique(np.concatenate(gathered, axis=1), axis=1)))

    met_rows = dealt.repartition(kit.width(spark), "cell").sortWithinPartitions("cell")
    if not seeks:
        return kit.mapped(met_rows, run, "a long, b long")
    found = kit.mapped(met_rows, run, "a long, b long, like double, part long")
    taken = found.groupBy("a").agg(F.array_distinct(F.array(F.max_by("b", F.struct("like", "b")), F.min_by("b", F.struct("part", "b")))).alias("b")).select("a", F.explode("b").alias("b"))
    return taken.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fingerprinted(maps: DataFrame) -> DataFrame:
    """(a, b) of the sets that SimHash links: sets of one fingerprint with the first of them, and those of fingerprints within simhash.BITS bits.

    Fingerprints meet in the buckets of simhash.links, where pivot distances discard pairs. maps: `_fp`, m.
    """
    prints = maps.select(F.col("m")[LONGS + 1].alias("print"), F.col("_fp").alias("node"))
    firsts = kit.stored(prints.groupBy("print").agg(F.min("node").alias("first")), "firsts")
    same = prints.join(firsts, "print").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = simhash.links(firsts.select(F.col("print").alias("_fp")))
    for end, name in (("a", "x"), ("b", "y")):
        near = near.join(firsts.select(F.col("print").alias(end), F.col("first").alias(name)), end)
    return same.union(near.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def likeliest(rows: DataFrame) -> DataFrame:
    """(a, b): for each set b the set it shares most prefix shingles with, of those that are first of a shingle."""
    w = [c for x in ("w", "pw") for c in (F.shiftright(x, 32), F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)))]
    counted = rows.where(F.col("_fp") != F.col("p")).where(fits(*w)).groupBy("_fp", "p").count()
    return counted.groupBy(F.col("_fp").alias("b")).agg(F.max_by("p", F.struct("count", "p")).alias("a")).select("a", "b")


def roots(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of all sets that links of the similarity join with others. prints: `_fp`, m of all texts.

    First the sets that SimHash links meet, and every set meets the likeliest of those it shares shingles with. SimHash
    links sets below the similarity and misses some above it, so each pair is checked by the sets. Then every set meets the
    one of another part whose map is most like its own and one of the lowest part that looks alike, and at last all that share a shingle and are not joined yet meet;
    a group of near copies makes few pairs. All but the last step set the cost, not the result.
    """
    maps = kit.stored(prints.where("m is not null").groupBy("_fp").agg(F.first("m").alias("m")), "maps")
    rows = met(sets(texts).where("s is not null").select("_fp", "s"), maps.count())
    one = sets(texts, "c").where("c is not null").select("_fp", "c")
    first = verified(fingerprinted(maps).union(likeliest(rows)), one, maps)
    some = unjoined(rows, first)
    joined = first.union(verified(meetings(some, maps, SEEKS), one, maps))
    rest = verified(meetings(unjoined(some.select("t", "_fp", "w"), joined), maps), one, maps)
    return components(joined.union(rest))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with the columns of docs; repeated rows of it become one.

    Groups are what links of five-word similarity 0.8 or more join. Texts of equal shingle sets are one set from the
    start; null, empty and word-less texts have the empty set; ids, null or repeated, play no part in the grouping. Texts
    of any length give whole sets, and an empty table gives no rows. Tables on the way are deleted before this returns.
    """
    rows, names = simhash.keyed(docs)
    texts = simhash.texts(rows, names)
    with kit.scratch(), kit.shuffles_freed(docs.sparkSession):
        prints = kit.stored(sets(texts, "m"), "prints")
        return simhash.one_of_each(rows, names, prints.drop("m"), roots(prints, texts))
