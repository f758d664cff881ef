"""Exact top-k by inner product: MaxScore over shards of an inverted index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from . import kit

TOP = 5
#: Queries sent to all tasks at once; more are searched in blocks of this size.
BLOCK = 8192
#: Vectors of one index shard.
SHARD = 8192
#: Rows of a posting that are probed before the threshold is looked at again.
PIECE = 1024
#: Terms that new rows are probed by one after the other; eight at a time.
PROBED = 16
#: Sums of products below this are exact in 64 bits; larger components are multiplied as Python integers.
EXACT = 1 << 62
_LONG = (1 << 63) - 1


def quantised(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(256 x), x as double; shorter vectors are filled up with zeros. 64-bit integers, or Python's where they are too small."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    if not out.size or np.abs(out).max() < 2.0**45:
        return np.floor(out * 256).astype(np.int64)
    whole = [[int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(x * 256)) for x in v] for v in out.tolist()]
    return np.array(whole, object).reshape(out.shape)


def usable(column) -> tuple[list, np.ndarray]:
    """The vectors of an Arrow list column that take part, and which of all they are."""
    vectors = [None if v is None else np.array([np.nan if x is None else x for x in v], float) for v in column.to_pylist()]
    valid = np.array([v is not None and bool(np.isfinite(v).all()) for v in vectors], bool)
    return [v for v, ok in zip(vectors, valid, strict=True) if ok], valid


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


class Shard:
    """Postings of one shard: for each dimension and sign, the vectors with such a component, largest magnitude first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.largest = ids[order], x[order], largest(x)
        self.postings = {}
        if x.dtype == object:
            return
        self.columns = np.ascontiguousarray(self.x.T)
        # sums below 2**53 are exact in doubles too, which multiply faster
        self.rows = self.x.astype(float) if x.shape[1] * self.largest**2 < 1 << 50 else self.x
        # bits of the rows whose dimension 0 is below, above zero, of dimension 1 below, ...
        self.member = np.packbits(np.stack([self.columns < 0, self.columns > 0], axis=1).reshape(2 * x.shape[1], len(ids)), axis=1)
        for d in range(x.shape[1]):
            column = self.x[:, d]
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                rows = rows[np.argsort(-np.abs(column[rows]), kind="stable")]
                self.postings[d, sign] = rows, int(abs(column[rows[0]])) if len(rows) else 0

    def plain(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, list[int]]:
        """The same for components too large for 64-bit sums: all rows, in Python's integers; scores end at the range of a long."""
        wanted = [int(q) for q in query]
        scored = [(-min(max(sum(int(a) * b for a, b in zip(self.x[i], wanted, strict=True)), -_LONG - 1), _LONG), int(self.ids[i]), i) for i in range(len(self.ids)) if own is None or self.ids[i] != own]
        best = sorted(scored)[:k]
        return np.array([i for *_, i in best], np.int64), [-s for s, *_ in best]

    def top(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to the smaller id.

        A term is a dimension and the sign that gives a gain; its bound is the largest gain in the shard. Postings are read
        from the largest bound on. A term is essential while the bounds of it and of all smaller ones reach the threshold,
        the k-th best score so far: it rises with every posting read, and below it a vector in none of the postings read
        can't be among the best, so reading ends. New vectors of a posting are probed term by term, the largest bounds
        first, and left when what they have and what is still possible is below the threshold.
        """
        n = self.x.shape[1]
        query = query[:n] if len(query) >= n else np.append(query, np.zeros(n - len(query), query.dtype))
        if self.x.dtype == object or query.dtype == object or n * self.largest * largest(query) >= (EXACT if self.rows is self.x else 1 << 53):
            return self.plain(query, own, k)
        terms = sorted((-abs(int(q)) * self.postings[d, 1 if q > 0 else -1][1], d) for d, q in enumerate(query.tolist()) if q)
        dims = np.array([d for _, d in terms], np.int64)
        left = np.cumsum([0, *(-b for b, _ in terms[::-1])])[::-1]  # bounds of term i and all after it
        seen = np.zeros(len(self.ids), bool)
        if own is not None:
            seen[self.ids == own] = True
        best, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), None
        rest = query.astype(self.rows.dtype)
        rest[dims[:PROBED]] = 0

        def weigh(rows):
            """Brings new rows into the best, and the threshold up."""
            nonlocal best, scores, least
            seen[rows] = True
            partial = np.zeros(len(rows), np.int64)
            for a in range(0, min(PROBED, len(dims)), 8):
                for d in dims[a : a + 8].tolist():
                    partial += self.columns[d][rows] * query[d]
                if least is not None:
                    possible = partial + left[min(a + 8, len(dims))] >= least
                    rows, partial = rows[possible], partial[possible]
            if len(dims) > PROBED:  # what is still competitive meets all other terms at once
                partial += (self.rows[rows] @ rest).astype(np.int64)
            rows, partial = np.append(best, rows), np.append(scores, partial)
            order = np.lexsort((self.ids[rows], -partial))[:k]
            best, scores = rows[order], partial[order]
            least = int(scores[-1]) if len(best) == k else None

        # the first rows and the heads of the strongest postings give a first threshold
        heads = [self.postings[d, 1 if query[d] > 0 else -1][0][: 4 * k] for d in dims[:4]]
        first = np.unique(np.concatenate([*heads, np.arange(min(len(self.ids), k + 1))]))
        weigh(first[~seen[first]])
        if len(dims):
            # the strongest posting in growing pieces, until its next components are too small for the threshold
            rows, a, piece = self.postings[dims[0], 1 if query[dims[0]] > 0 else -1][0], 0, PIECE
            while a < len(rows) and (least is None or abs(int(query[dims[0]]) * int(self.x[rows[a], dims[0]])) + left[1] >= least):
                some = rows[a : a + piece]
                weigh(some[~seen[some]])
                a, piece = a + piece, piece * 4
            # then the union of the other essential ones, a half at a time: the threshold rises and the union shrinks
            keys = [2 * d + (query[d] > 0) for d in dims.tolist()]
            while True:
                essential = len(dims) if least is None else int(np.searchsorted(-left[:-1], -least, "right"))
                union = np.bitwise_or.reduce(self.member[keys[1:essential]], axis=0)
                rows = np.flatnonzero(np.unpackbits(union, count=len(seen)).view(bool) & ~seen)
                if not len(rows):
                    break
                weigh(rows[: max(PIECE, len(rows) // 2)])
        if least is None or least <= 0:
            rest = np.flatnonzero(~seen)  # vectors in no posting can be among the best
            weigh(rest)
        return best, scores


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of largest integer inner product, never the query's own id.

    vectors and queries: vec_id, embedding. Each task makes index shards of its rows and answers all queries of a block
    from them; the shards' answers meet by query, best k per task first. Queries go to the tasks in blocks of bounded
    size, one pass each; of several passes each writes its answers, so no plan grows with the queries. Null vectors, and
    vectors with null or non-finite components, take no part; shorter vectors count as filled up with zeros. Components
    of any size are exact; only a score beyond the range of a long is held to it. Rows without an id take no part.
    Repeated rows of an id compete each on its own; of repeated queries of an id all valid rows are asked (equal
    ones once), and the id gets the k best of their answers. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    clean = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    asked = queries.where("vec_id is not null").where(clean).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").distinct()
    n = -(-asked.count() // block)
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if n > 1:  # dealt out once and written, so that each pass finds its own
        asked = kit.stored(asked.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))), "queries")
    path = kit.scratch_path(spark, "answers")
    for b in range(n):
        mine = (asked.where(F.col("_block") == b) if n > 1 else asked).select("vec_id", "embedding").toArrow()
        found, _ = usable(mine.column("embedding"))
        sent = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), [quantised([v])[0] for v in found]))
        out = _answers(vectors, sent, k)
        if n > 1:
            out.write.mode("append").parquet(path)
            sent.destroy()
    if n > 1:
        out = spark.read.schema(out.schema).parquet(path)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(vectors: DataFrame, queries, k: int) -> DataFrame:
    def run(batches, out):
        asked, wanted = queries.value
        held: list = []
        n = 0

        def answer():
            shard = Shard(np.concatenate([i for i, _ in held]), quantised([v for _, some in held for v in some]))
            rows, scores, of = [], [], []
            for q, v in zip(asked.tolist(), wanted, strict=True):
                r, s = shard.top(v, q, k)
                rows.append(shard.ids[r])
                scores += list(s)
                of.append(np.full(len(r), q))
            return kit.record(out, [np.concatenate(of), np.concatenate(rows), [int(s) for s in scores]])

        for batch in batches:
            found, valid = usable(batch.column("embedding"))
            if valid.any() and len(asked):
                held.append((batch.column("vec_id").to_numpy(zero_copy_only=False)[valid].astype(np.int64), found))
                n += int(valid.sum())
            if n >= SHARD:
                yield answer()
                held, n = [], 0
        if n:
            yield answer()

    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return kit.mapped(rows, run, "query_id long, vec_id long, score long")


def report(vectors: DataFrame) -> DataFrame:
    """The query set is every row whose vec_id is divisible by 50."""
    return search(vectors, vectors.where("vec_id % 50 = 0"))
