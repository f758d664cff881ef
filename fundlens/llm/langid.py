"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import kit

#: Labelled documents a language used for learning, in expectation.
SAMPLE_DOCS = 2000
#: Bytes of an n-gram, slots of a filter, hash functions.
GRAM = 4
SLOTS = 1 << 21
HASHES = 3
#: An n-gram belongs to a language in which it occurs as often as this, and this much of its rate where it is most frequent.
LEAST_COUNT = 3
LEAST_RATE = 0.15

# ASCII letters in lower case, all that is not ASCII as it is, the rest blank
_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[0x61:0x7B] = _NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
_NORMAL[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams with a letter of all texts, as integers, and the n + 1 gram offsets. Texts stand between blanks."""
    pad = GRAM - 1
    n = len(offsets) - 1
    line = np.full(len(data) + pad * (n + 1), 0x20, np.uint8)
    line[np.arange(len(data)) + pad * (1 + np.repeat(np.arange(n), np.diff(offsets)))] = _NORMAL[data]
    found = np.zeros(len(line) - pad, np.uint32)
    for k in range(GRAM):
        found |= line[k : len(line) - pad + k].astype(np.uint32) << np.uint32(8 * k)
    lettered = np.flatnonzero(found != np.uint32(0x20202020))
    # a gram belongs to the text in which it starts, or before which it starts with blanks
    return found[lettered], np.searchsorted(lettered, offsets + pad * np.arange(n + 1))


def slots(gram: np.ndarray) -> list[np.ndarray]:
    h = kit.mix(gram.astype(np.uint64) + np.uint64(1))
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    languages: list[str]
    #: for each 64 languages (8 to a byte where few), a mask of languages a slot
    filters: list[np.ndarray]
    usual: int  # the language with most training documents

    def __post_init__(self):
        n = len(self.languages)
        bits = np.arange(64, dtype=np.uint64)
        fill = [(np.bitwise_count(f[None, :] & (np.uint64(1) << bits[:, None]).astype(f.dtype)) > 0).mean(axis=1) if f.itemsize == 8 else np.array([(f >> k & 1).mean() for k in range(8)]) for f in self.filters]
        self.false = np.concatenate(fill)[:n] ** HASHES if n else np.zeros(0)

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        """For each filter, the mask of all languages that hold each n-gram."""
        at = slots(gram)
        out = []
        for f in self.filters:
            m = f[at[0]]
            for s in at[1:]:
                m = m & f[s]
            out.append(m)
        return out

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of corrected shares (of a text's n-grams, those held by each language), and the n-gram counts."""
        gram, bounds = grams(data, offsets)
        sizes = np.diff(bounds)
        counts = np.zeros((len(sizes), len(self.languages)))
        text = np.repeat(np.arange(len(sizes)), sizes)
        for k, mask in enumerate(self.masks(gram)):
            if mask.itemsize == 1:
                # how often each mask occurs in each text, then the bits of the masks
                seen = np.bincount(text * 256 + mask, minlength=256 * len(sizes)).reshape(len(sizes), 256)
                bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
                counts += (seen @ bits)[:, : len(self.languages)]
            else:
                for b in range(min(64, len(self.languages) - 64 * k)):
                    counts[:, 64 * k + b] = np.bincount(text, (mask >> np.uint64(b)) & np.uint64(1), len(sizes))
        n = sizes[:, None]
        fair = (counts - n * self.false) / np.maximum(1 - self.false, 1e-9)
        return np.clip(fair, 0, n) / np.maximum(n, 1), sizes


def learn(docs: DataFrame, most: int = SAMPLE_DOCS) -> Model:
    """Filters from text and lang of a bounded sample: about `most` documents a language, by hash of the id."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = kit.group_sizes(labelled, "lang")
    languages = sorted(sizes)
    if not languages:
        return Model([], [], 0)
    sample = kit.sampled(labelled, "doc_id", "lang", sizes, most, 1)

    def count(batches, out):
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for lang in sorted(set(names)):
                rows = batch.filter(pa.array([x == lang for x in names]))
                for _, data, offsets in kit.chunks(rows):
                    gram, n = np.unique(grams(data, offsets)[0], return_counts=True)
                    yield kit.record(out, [pa.array([lang] * len(gram)), gram.astype(np.int64), n])

    counts = kit.mapped(sample.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = kit.stored(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    highest = rates.groupBy(F.col("gram").alias("g")).agg(F.max("rate").alias("highest"))
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    held = rates.where(F.col("n") >= LEAST_COUNT).join(highest, F.col("gram") == F.col("g")).where(F.col("rate") >= LEAST_RATE * F.col("highest"))
    word = held.select("gram", number.alias("number")).selectExpr("gram", "number div 64 AS word", "shiftleft(1L, number % 64) AS bit").groupBy("gram", "word").agg(F.bit_or("bit").alias("mask"))
    rows = word.toArrow()
    filters = [np.zeros(SLOTS, np.uint64) for _ in range(-(-len(languages) // 64))]
    for k, f in enumerate(filters):
        mine = rows.filter(pc.equal(rows.column("word"), k))
        gram, mask = mine.column("gram").to_numpy().astype(np.uint32), mine.column("mask").to_numpy().view(np.uint64)
        for s in slots(gram):
            np.bitwise_or.at(f, s, mask)
    if len(languages) <= 8:
        filters = [filters[0].astype(np.uint8)]
    return Model(languages, filters, languages.index(max(languages, key=lambda x: (sizes[x], x))))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with `_lang` and `_score` of the whole text.

    A text's language is the one that holds most of its n-grams after correction for false positives; ties go to the
    language first by name, a text with none of the known n-grams to the one with most training documents (score 0).
    The score is that language's share of all corrected counts. Null or letterless text, or no learned language: `und`, 0.
    Repeated rows are predicted alike, texts of any length count whole, and an empty table gives no rows.
    """
    names = [n for n in docs.columns if n != "text"]
    schema = docs.select(*names, F.lit("").alias("_lang"), F.lit(0.0).alias("_score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, out):
        m = shared.value
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch):
                ascii_letters = np.append(0, np.cumsum((_NORMAL[data] != 0x20) & (data < 0x80)))
                lettered = np.diff(ascii_letters[offsets]) > 0
                for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                    lettered[i] = any(map(str.isalpha, rows.column("text")[int(i)].as_py() or ""))
                if m.languages:
                    part, _ = m.shares(data, offsets)
                    total = part.sum(axis=1)
                    best = np.where(total > 0, part.argmax(axis=1), m.usual)
                    score = np.where(total > 0, part.max(axis=1) / np.maximum(total, 1e-300), 0.0)
                    lang = [m.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                else:
                    lang, score = ["und"] * rows.num_rows, np.zeros(rows.num_rows)
                yield kit.record(out, [*(rows.column(n) for n in names), pa.array(lang), np.where([x == "und" for x in lang], 0.0, score)])

    return kit.mapped(docs, run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs; learns from the rows not held out."""
    held_out = kit.fold(F.col("doc_id"), 4) == 2
    out = predicted(docs.select("doc_id", "text"), learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
