"""Fill-in-middle transformation: documents cut at token or code point borders by a sparse index of multibyte characters."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kit

#: The marks of prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Documents of a hundred that stay plain, and of the others those that put the suffix first.
PLAIN, SPM = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


class ExceptionIndex:
    """Byte and code point positions of UTF-8 bytes, from their multibyte characters alone.

    Kept are the byte position of each such character and how many bytes it and those before it take beyond one each. A
    cut moves by the excess of the characters before it, found by binary search; text without any is pure arithmetic.
    """

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])  # excess of the first k exceptions
        self.at_char = self.at - self.before[:-1]

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut; a cut stands at the start of a character or at the end."""
        return cuts - self.before[np.searchsorted(self.at, cuts, "left")] if len(self.at) else cuts

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each code point cut."""
        return cuts + self.before[np.searchsorted(self.at_char, cuts, "left")] if len(self.at) else cuts


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions of the tokens `[A-Za-z]+|[^A-Za-z]` of all texts; a run of letters ends with its text."""
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    inner = letter[1:] & letter[:-1]
    start[1:] &= ~inner
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = True
    return np.flatnonzero(start)


def draws(doc_id: int | None) -> list[int]:
    """Four even 32-bit numbers of a document; a null id draws as the empty text."""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def transformed(docs: DataFrame, unit: str = "token", plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """docs without text, with `_n` (units), `_form`, `_prefix_chars`, `_middle_chars` and `_output` (the whole new text).

    unit: "token" cuts between tokens `[A-Za-z]+|[^A-Za-z]`, "char" between code points. Both cuts and the form follow
    from the id alone, so reruns and copies of a row agree; plain and spm are shares of a hundred. Null and empty texts,
    and texts that hold a mark themselves, stay plain (null becomes empty) and have null lengths. Texts of any length
    are cut whole; an empty table gives no rows; a document takes one pass without shuffle. A null id draws as the
    empty text.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit {unit}")
    names = [n for n in docs.columns if n != "text"]
    long = F.lit(0).cast("long")
    none = F.when(F.lit(False), long)
    schema = docs.select(*names, long.alias("_n"), F.lit("").alias("_form"), none.alias("_prefix_chars"), none.alias("_middle_chars"), F.lit("").alias("_output")).schema
    at_id = docs.columns.index("doc_id")

    def run(batches, out):
        for batch in batches:
            for rows, data, offsets in kit.chunks(batch):
                ids = rows.column(at_id).to_pylist()
                h = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
                index = ExceptionIndex(data)
                if unit == "token":
                    starts = np.append(token_starts(data, offsets), len(data))
                    base = np.searchsorted(starts, offsets, "left")
                else:
                    base = index.chars(offsets)
                n = np.diff(base)
                low = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)) + base[:-1]
                high = np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)) + base[:-1]
                if unit == "token":
                    # the start of the next text's first token is this text's end
                    a, b = np.minimum(starts[low], offsets[1:]), np.minimum(starts[high], offsets[1:])
                    ca, cb, c0 = index.chars(a), index.chars(b), index.chars(offsets[:-1])
                else:
                    a, b, ca, cb, c0 = index.bytes(low), index.bytes(high), low, high, base[:-1]
                flat = data.tobytes()
                texts = [flat[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                whole = np.array([not t or PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], bool) | (h[:, 2] % 100 >= 100 - plain)
                forms = np.where(whole, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm")).tolist()
                outputs = [arranged(t, f, x, y) for t, f, x, y in zip(texts, forms, (a - offsets[:-1]).tolist(), (b - offsets[:-1]).tolist(), strict=True)]
                yield kit.record(
                    out,
                    [*(rows.column(c) for c in names), n, pa.array(forms), pa.array(ca - c0, pa.int64(), mask=whole), pa.array(cb - ca, pa.int64(), mask=whole), pa.array(outputs, pa.binary()).cast(pa.string())],
                )

    return kit.mapped(docs, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: no part holds a mark and no mark can arise at a seam, so the marks cut exactly."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts.getItem(1), parts.getItem(3), parts.getItem(2))
    spm = F.concat(parts.getItem(2), parts.getItem(3), parts.getItem(1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the sha256 of the output and of the text restored from it, one row for each row of docs."""
    rows = transformed(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"),
        F.sha2(F.col("_output"), 256).alias("output_sha256"), F.sha2(restored(F.col("_output"), F.col("_form")), 256).alias("restored_sha256"),
    )
