"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import kit

#: Buckets of the hashed n-gram models, and bytes of an n-gram.
BUCKETS = 1 << 16
GRAM = 4
#: Labelled documents of each class used for the target model and the threshold, in expectation.
SAMPLE_DOCS = 5000
SMOOTHING = 0.5
#: Bytes of text whose n-grams are numbered at a time; a byte takes some fifty on the way.
SLICE = 1 << 18
#: A log ratio per n-gram counts as that of a document of so many n-grams, whatever its length.
LENGTH = 1000.0


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each n-gram of bytes, and for each word that repeats the word before it; with the text of each."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = max(0, len(data) - GRAM + 1)
    found = np.zeros(n, np.uint32)
    for k in range(GRAM):
        found |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    inside = text[:n] == text[GRAM - 1 :] if n else np.zeros(0, bool)
    # multiplicative hashing: the high bits choose
    gram = ((found[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % (BUCKETS - 1)
    words, bounds = kit.hashed_words(data, offsets, kit.NOT_BLANK)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])) + 1
    return np.concatenate([gram, np.full(len(again), BUCKETS - 1)]), np.concatenate([text[:n][inside], doc[again]])


@dataclass
class Model:
    log_ratio: np.ndarray  # log p(target) - log p(raw), a bucket each
    threshold: float  # of the mean log ratio


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> tuple[Model, dict]:
    """Raw model: n-grams of all documents. Target model: those of a bounded sample of good labelled documents.

    Returns the model without threshold and the sample (doc_id -> quality), of about `most` ids a class by hash.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = {r["doc_id"]: int(r["quality"]) for r in kit.sampled(known, "doc_id", "quality", kit.group_sizes(known, "quality"), most, 2).collect()}
    good = docs.sparkSession.sparkContext.broadcast(frozenset(d for d, q in sample.items() if q == 1))

    def count(batches, out):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch, most=SLICE):
                bucket, text = buckets(data, offsets)
                raw += np.bincount(bucket, minlength=BUCKETS)
                chosen = np.array([d in good.value for d in rows.column("doc_id").to_pylist()], bool)
                if chosen.any():
                    target += np.bincount(bucket[chosen[text]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield kit.record(out, [some, raw[some], target[some]])

    counts = kit.mapped(docs.select("doc_id", "text"), count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()

    def log_p(n):
        return np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))

    # the raw model is scaled to the target's amount of text, so that smoothing favours neither
    ratio = log_p(target) - log_p(raw * (target.sum() / max(raw.sum(), 1.0))) if target.sum() else np.zeros(BUCKETS)
    return Model(ratio, -np.inf), sample


def threshold(means: np.ndarray, quality: np.ndarray, loss: float = 5.0) -> float:
    """Midway between the two labelled scores around the best cut; to lose a good document costs `loss` times a poor one kept."""
    if not len(means) or (quality == 1).all() or not (quality == 1).any():
        return -np.inf
    order = np.argsort(means, kind="stable")
    s, q = means[order], quality[order]
    good, poor = (q == 1) / (q == 1).sum(), (q == 0) / (q == 0).sum()
    cost = np.append(0, loss * np.cumsum(good) - np.cumsum(poor))  # of rejecting the first i
    i = len(cost) - 1 - int(np.argmin(cost[::-1]))
    return -np.inf if i == 0 else np.inf if i == len(s) else float((s[i - 1] + s[i]) / 2)


def keyed(docs: DataFrame, model: Model, seed: int, with_text: bool = False) -> DataFrame:
    """docs, or docs without text, with `_mean` (log ratio per n-gram of the whole text) and `_noise` (Gumbel, from the id and the seed)."""
    names = [n for n in docs.columns if with_text or n != "text"]
    schema = docs.select(*names, F.lit(0.0).alias("_mean"), F.lit(0.0).alias("_noise")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model.log_ratio)

    def run(batches, out):
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch, most=SLICE):
                bucket, text = buckets(data, offsets)
                n = np.bincount(text, minlength=rows.num_rows)
                mean = np.bincount(text, shared.value[bucket], rows.num_rows) / np.maximum(n, 1)
                ids = np.array([hash_id(d, seed) for d in rows.column("doc_id").to_pylist()], np.uint64)
                even = ((kit.mix(ids) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                yield kit.record(out, [*(rows.column(n) for n in names), mean, -np.log(-np.log(even))])

    return kit.mapped(docs, run, schema)


def hash_id(doc_id, seed: int) -> int:
    return ((-1 if doc_id is None else int(doc_id)) * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F + 1) & (1 << 64) - 1


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, by counts of 16 bits at a time: four passes, none sorts or collects rows."""
    prefix, left = 0, k
    # compare as unsigned, sign bit flipped
    shifted = rows.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("u"))
    for shift in (48, 32, 16, 0):
        if shift < 48:
            signed = prefix - (1 << 64 - shift - 16) if prefix >> (47 - shift) & 1 else prefix
            here = shifted.where(F.shiftright("u", shift + 16) == F.lit(signed))
        else:
            here = shifted
        counts = here.groupBy(F.shiftright("u", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")).agg(F.count("*").alias("n")).collect()
        for digit, n in sorted(((r["digit"], r["n"]) for r in counts), reverse=True):
            if n >= left:
                prefix = prefix << 16 | digit
                break
            left -= n
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >> 63 else value


@dataclass
class Plan:
    model: Model
    base: float  # the mean log ratio that weighs 0
    k: int
    last: int | None  # the k-th largest key, where not all or none are kept

    def weighed(self, rows: DataFrame) -> DataFrame:
        """log_weight, sample_key and kept of keyed rows. Keys are compared to the billionth, as longs."""
        weight = (F.col("_mean") - self.base) * LENGTH
        out = rows.withColumn("_log_weight", weight).withColumn("_sample_key", F.col("_log_weight") + F.col("_noise")).withColumn("_order", F.floor(F.col("_sample_key") * 1e9).cast("long"))
        return out.withColumn("_kept", F.lit(self.k > 0) if self.last is None else F.col("_order") >= F.lit(self.last))


def plan(docs: DataFrame, labels: DataFrame, keep: float | None, seed: int) -> tuple[Plan, DataFrame]:
    """What decides the sample, and the keyed rows (without text) that it was made from."""
    model, sample = learn(docs, labels)
    spark = docs.sparkSession
    rows = kit.stored(keyed(docs.select("doc_id", "text"), model, seed), "quality")
    ids = spark.createDataFrame(list(sample.items()), "_id long, quality int")
    known = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("_mean", "quality").toArrow()
    cut = threshold(known.column("_mean").to_numpy(), known.column("quality").to_numpy())
    out = Plan(model, cut if np.isfinite(cut) else 0.0, 1, None)
    n = out.weighed(rows).agg(F.count("*"), F.count(F.when(F.col("_log_weight") >= 0, 1))).first()
    out.k = round(n[0] * keep) if keep is not None else n[1] if np.isfinite(cut) else n[0] if cut < 0 else 0
    if 0 < out.k < n[0]:
        out.last = kth_largest(out.weighed(rows), "_order", out.k)
    return out, rows


def resampled(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 42) -> DataFrame:
    """doc_id, mean_log_ratio, log_weight, sample_key and kept, one row for each row of docs (doc_id, text).

    Importance weight: the target model's probability of the text's n-grams over the raw model's, tempered to documents
    of LENGTH n-grams and counted from the threshold that separates good from poor labelled documents. The Gumbel noise
    added to the log weight makes the k largest keys a sample without replacement; k is `keep` of all documents or, by
    default, the number of documents at or above the threshold. Keys tied with the k-th are all kept. Null, empty and
    very short texts have no n-grams, log ratio 0 and are weighed as such; repeated rows share noise and fate. Without
    good labelled documents, or without poor ones, all are kept. Texts of any length count whole; an empty table gives no rows.
    """
    decided, rows = plan(docs, labels, keep, seed)
    return decided.weighed(rows).select("doc_id", F.col("_mean").alias("mean_log_ratio"), F.col("_log_weight").alias("log_weight"), F.col("_sample_key").alias("sample_key"), F.col("_kept").alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 42) -> DataFrame:
    """The rows of docs that the sample keeps. Texts are scored once more rather than shuffled."""
    decided, _ = plan(docs, labels, keep, seed)
    inner, names = kit.numbered(docs)
    for own in ("doc_id", "text"):
        inner = inner.withColumnRenamed(f"c{names.index(own)}", own)
    columns = inner.columns
    return decided.weighed(keyed(inner, decided.model, seed, True)).where("_kept").select(*columns).toDF(*names)
