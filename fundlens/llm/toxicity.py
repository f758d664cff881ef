"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated thresholds."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kit
from .shingles import shingle_sets

#: Labelled documents of each class used for learning, in expectation; whole texts, of any length.
SAMPLE_DOCS = 3000
WINDOW_WORDS = 4
WINDOW_BYTES = 256
#: Compression levels that are tried; the calibration half decides.
LEVELS = (3, 5, 7)
ORDINARY_BYTES = 8192
#: Windows of ordinary sample texts that the ordinary dictionary is trained on, at most, by hash of the window.
ORDINARY_WINDOWS = 40_000
#: Bytes of the telling strings in the toxic dictionary, at most, the most frequent ones.
TOXIC_BYTES = 1 << 16
#: Bytes of the strings whose frequency in toxic and ordinary training texts is compared.
GRAM = 6
STEPS = (1, 2, 3, 4, 5, 6)
#: Sample texts of one class whose five-word similarity is estimated at this or more count once.
ALIKE = 0.5
SKETCH, BAND = 96, 3

# ASCII letters in lower case and all that is not ASCII stay, the rest is blank
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())


def windows(text: str | None) -> list[bytes]:
    """The whole text as windows of a few words each; a longer one is cut into pieces."""
    words = (text or "").encode("utf-8", "replace").translate(_LETTERS).split()
    out = []
    for i in range(0, len(words), WINDOW_WORDS):
        w = b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" "
        out += [w] if len(w) <= WINDOW_BYTES else [w[j : j + WINDOW_BYTES] for j in range(0, len(w), WINDOW_BYTES)]
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the intercept comes last
    level: int = LEVELS[0]

    def compressors(self):
        import zstandard

        def of(content: bytes):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        return of(self.ordinary), of(self.toxic)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -40, 40)
        return 1 / (1 + np.exp(-z))


def gains(text: str | None, pair) -> np.ndarray:
    """For each window, by how many bytes the toxic dictionary compresses it better than the ordinary one."""
    ordinary, toxic = pair
    return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), np.int64)


def features(gain: np.ndarray) -> np.ndarray:
    n = len(gain)
    if not n:
        return np.zeros(2 + 2 * len(STEPS))
    over = np.array([(gain >= s).sum() for s in STEPS], float)
    return np.concatenate([[gain.mean(), gain.max()], over / n, np.log((over + 0.5) / (n * 0.02 + 1.0))])


def spaced(text: str | None) -> bytes:
    """The words of a text with one blank around each."""
    return b" " + b" ".join((text or "").encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def grams(words: bytes) -> set[bytes]:
    """The distinct grams of single words, blanks included."""
    return {w[i : i + GRAM] for w in (b" " + v + b" " for v in set(words.split())) for i in range(max(1, len(w) - GRAM + 1))}


def is_telling(a: int, b: int, n1: int, n0: int) -> bool:
    """Whether a gram in a of n1 toxic and b of n0 ordinary texts tells: three texts, z over 5, share over four times."""
    p = (a + b) / (n0 + n1)
    spread = max(n1 * p * (1 - p) * n0 / (n0 + n1), 1e-9) ** 0.5
    return a >= 3 and (a - n1 * p) / spread > 5 and a / n1 > 4 * (b + 1) / (n0 + 1)


def strings(words: bytes, telling: set[bytes]) -> list[bytes]:
    """The parts of a text that telling grams make."""
    out = []
    hits = [i for i in range(len(words) - GRAM + 1) if words[i : i + GRAM] in telling and b" " not in words[i + 1 : i + GRAM - 1]] if telling else []
    at = 0
    while at < len(hits):
        start = end = hits[at]
        while at < len(hits) and hits[at] <= end:
            end = hits[at] + GRAM
            at += 1
        out.append(words[start : max(end, start + 9)])
    return out


def telling_strings(texts: list[tuple[str, int]]) -> list[bytes]:
    """Strings of toxic training texts made of grams much more frequent in toxic documents; the most frequent come last. Equal texts of a class count once."""
    joined = [(spaced(t), y) for t, y in texts]
    once = {(y, blake2b(b, digest_size=16).digest()): b for b, y in joined}
    counts, totals = (Counter(), Counter()), Counter(y for y, _ in once)
    for (y, _), b in once.items():
        counts[y].update(grams(b))
    telling = {g for g, a in counts[1].items() if is_telling(a, counts[0][g], totals[1], totals[0])}
    found = Counter(s for b, y in joined if y for s in strings(b, telling))
    return [s for s, _ in found.most_common()][::-1]


# -- learning -------------------------------------------------------------------------------------------------


def sketches(sample: DataFrame) -> DataFrame:
    """_k, toxic and the smallest hashes of the five-word shingles of each sample text under SKETCH mixings."""
    salts = kit.mix(np.arange(1, SKETCH + 1, dtype=np.uint64))

    def run(batches, out):
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch):
                sets = [s.view(np.uint64) for s in shingle_sets(data, offsets)]
                least = [np.array([kit.mix(s ^ x).min() if len(s) else 0 for x in salts], np.uint64) for s in sets]
                yield kit.record(out, [rows.column("_k"), rows.column("toxic"), pa.array([x.tobytes() for x in least], pa.binary())])

    return kit.mapped(sample.select("_k", "toxic", "text"), run, "_k long, toxic int, sketch binary")


def one_of_each(keys: list[int], classes: list[int], sketch: np.ndarray) -> dict[int, int]:
    """{key: half} of one text for each group of alike texts of a class; halves are dealt out by the key.

    A text joins the first of a band if their sketches agree in a share of ALIKE or more.
    """
    order = sorted(range(len(keys)), key=lambda i: (classes[i], keys[i]))
    parent = {i: i for i in order}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    place = {i: p for p, i in enumerate(order)}
    for at in range(0, SKETCH, BAND):
        first: dict = {}
        for i in order:
            j = first.setdefault((classes[i], sketch[i, at : at + BAND].tobytes()), i)
            if j != i and (sketch[i] == sketch[j]).mean() >= ALIKE:
                a, b = sorted((root(i), root(j)), key=place.__getitem__)
                parent[b] = a
    heads: dict[int, list[int]] = {}
    for i in order:
        if root(i) == i:
            heads.setdefault(classes[i], []).append(keys[i])
    return {k: n % 2 for mine in heads.values() for n, k in enumerate(sorted(mine, key=lambda k: int(kit.mix(np.array([k], np.int64).view(np.uint64))[0])))}


def fitted(model: Model, x: np.ndarray, y: np.ndarray, prior: float) -> float:
    """Sets the weights of a model from feature rows; the area under the curve of its scores on them."""
    importance = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(z.shape[1] - 1, 1.0), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (importance * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (importance * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    # 0.5 becomes the score that separates the classes best (by F1, classes at their shares)
    s = z @ w
    order = np.argsort(-s, kind="stable")
    hit, miss = np.cumsum((importance * y)[order]), np.cumsum((importance * (1 - y))[order])
    best = int(np.argmax(2 * hit / (hit + miss + (importance * y).sum())))
    w[-1] -= (s[order[best]] + s[order[min(best + 1, len(s) - 1)]]) / 2
    model.weights = w
    low = np.searchsorted(np.sort(s[y == 0]), s[y == 1], "left") + np.searchsorted(np.sort(s[y == 0]), s[y == 1], "right")
    return float(low.sum() / 2 / max((y == 1).sum() * (y == 0).sum(), 1))


def dictionary(plain: list[bytes], level: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, plain, k=24, d=6, level=level).as_bytes()
    except zstandard.ZstdError:  # too little text for entropy tables: its bytes are the dictionary
        return b"".join(plain)[-ORDINARY_BYTES:]


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Model | None:
    """A model from a bounded sample: about `most` labelled documents a class, whole texts, by hash of the id. None without both classes.

    Of texts of a class that are near copies of each other one counts, in one half of the sample: the first half makes the
    dictionaries, the second sets the thresholds and the compression level. Texts stay on Spark; what comes to the
    driver is bounded by the sample and by the sizes above: sketches, telling grams and strings, ordinary windows and
    one row of features a text.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = kit.group_sizes(known, "toxic")
    if len(counts) < 2:
        return None
    ids = kit.sampled(known, "doc_id", "toxic", counts, most, 3)
    found = docs.select("doc_id", "text").join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    sample = kit.stored(found.select(F.xxhash64("doc_id", "text").alias("_k"), "text", "toxic"), "toxic-sample")
    drawn = sketches(sample).distinct().collect()
    halves = one_of_each([r["_k"] for r in drawn], [r["toxic"] for r in drawn], np.array([np.frombuffer(r["sketch"], np.uint64) for r in drawn], np.uint64).reshape(-1, SKETCH))
    sizes = Counter((halves[r["_k"]], r["toxic"]) for r in drawn if r["_k"] in halves)
    if len(sizes) < 4:
        return None
    n0, n1 = sizes[0, 0], sizes[0, 1]

    def each(half, give, schema, only=None):
        """Rows that `give` makes of each text of a half."""

        def run(batches, out):
            for batch in batches:
                for rows, _, _ in kit.chunks(batch):
                    made = [r for k, t, y in zip(*(rows.column(c).to_pylist() for c in ("_k", "text", "toxic")), strict=True) if halves.get(k) == half and only in (None, y) for r in give(t, y)]
                    if made:
                        yield kit.record(out, [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)])

        return kit.mapped(sample.dropDuplicates(["_k"]), run, schema)

    both = each(0, lambda t, y: [(g, y) for g in grams(spaced(t))], "gram binary, toxic int").groupBy("gram").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("a >= 3")
    telling = {bytes(r["gram"]) for r in both.collect() if is_telling(r["a"], r["n"] - r["a"], n1, n0)}
    told = each(0, lambda t, y: [(s,) for s in strings(spaced(t), telling)], "s binary", 1).groupBy("s").count().orderBy(F.desc("count"), "s").limit(TOXIC_BYTES // 9).collect()
    tail = b"".join(bytes(r["s"]) for r in told[::-1])[-TOXIC_BYTES:]
    words = each(0, lambda t, y: [(w,) for w in windows(t)], "w binary", 0)
    plain = [bytes(r["w"]) for r in words.orderBy(F.xxhash64("w"), "w").limit(ORDINARY_WINDOWS).collect()]
    models = []
    for level in LEVELS:
        ordinary = dictionary(plain, level)
        if len(ordinary) >= 8:
            models.append(Model(ordinary, ordinary + tail, np.zeros(1), np.ones(1), np.zeros(1), level))
    if not models:
        return None

    pairs: list = []  # made once a task

    def measured(t, y):
        if not pairs:
            pairs.extend(m.compressors() for m in models)
        return [(y, [v for pair in pairs for v in features(gains(t, pair))])]

    rows = sorted((r["toxic"], r["x"]) for r in each(1, measured, "toxic int, x array<double>").collect())
    y, x = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    prior, width = counts[1] / (counts[0] + counts[1]), x.shape[1] // len(models)
    fits = [fitted(m, x[:, i * width : (i + 1) * width], y, prior) for i, m in enumerate(models)]
    return models[int(np.argmax(fits))]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without text, with `_score` (0 to 1, of the whole text) and `_windows`.

    Null, empty and letterless texts have no windows and get the score of a text without any gain. Without a model (a
    class without labelled rows) every score is 0. Repeated rows and ties score alike, very long texts go whole, and an
    empty table gives no rows.
    """
    names = [n for n in docs.columns if n != "text"]
    schema = docs.select(*names, F.lit(0.0).alias("_score"), F.lit(0).cast("long").alias("_windows")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, out):
        m = shared.value
        pair = m.compressors() if m else None
        for batch in batches:
            for rows, _, _ in kit.chunks(batch):
                found = [gains(t, pair) for t in rows.column("text").to_pylist()] if m else [[]] * rows.num_rows
                scores = m.score(np.array([features(g) for g in found])) if m else np.zeros(rows.num_rows)
                yield kit.record(out, [*(rows.column(n) for n in names), scores, np.array([len(g) for g in found], np.int64)])

    return kit.mapped(docs, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows: one row for each row of docs; learns from the rows not held out."""
    learning = labels.where(kit.fold(F.col("doc_id"), 5) != 0)
    model = learn(docs, learning)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (kit.fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_windows").alias("n_windows"))
