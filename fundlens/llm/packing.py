"""Packing token sequences: sum-of-squares online placement over an array of fill levels."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kit

CAPACITY = 1024
#: Windows that a task holds open; beyond it they are filled up from each other by cutting.
OPEN_WINDOWS = 4096
#: Distinct units of text whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000

# -- ids ------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
#: A blank and characters that are no blanks: such units can be encoded joined, as only their first pieces start with a blank.
_PLAIN = re.compile("[ ][!-~À-ɏ]+")


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a text can be cut without changing its pieces: before a blank that follows no blank, ASCII or not.

    No piece of the byte-level pattern goes on from another character to a blank, so ids of the parts joined are ids of
    the whole. Behind a non-ASCII character that may itself be a blank nothing is cut.
    """
    before = np.zeros(len(data), bool)
    before[1:] = _GRAPHIC[data[:-1]]
    tail = np.flatnonzero(_SPACE[data[1:]] & (data[:-1] >= 0x80)) + 1  # blanks behind a non-ASCII character
    if len(tail):
        last, second = data[tail - 1], data[np.maximum(tail - 2, 0)]
        third = data[np.maximum(tail - 3, 0)]
        blank = ((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3) & ((second == 0x9A) | (second == 0x80) | (second == 0x81)))
        before[tail] = ~blank
    start = _SPACE[data] & before
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(start)


class UnitIds:
    """Token ids of the units of texts by hash of the unit."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.blank_first = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[int, np.ndarray] = {}

    def encode(self, units: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(units)
        plain = [i for i, u in enumerate(units) if _PLAIN.fullmatch(u)]
        for a in range(0, len(plain), 2048):
            part = plain[a : a + 2048]
            ids = np.array(self.tokenizer.encode("".join([units[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.blank_first[ids])
            if len(cuts) == len(part):
                for i, some in zip(part, np.split(ids, cuts[1:]), strict=True):
                    out[i] = some
        rest = [i for i, x in enumerate(out) if x is None]
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, np.uint32)
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text closed by `end_id`, and the n + 1 offsets of the texts in them."""
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, first, which = np.unique(kit.spans_hashed(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        names = keys.tolist()
        found = [self.known.get(k) for k in names]
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            flat = data.tobytes()
            for i, ids in zip(new, self.encode([flat[starts[f] : ends[f]].decode() for f in first[new]]), strict=True):
                found[i] = self.known[names[i]] = ids
        size = np.fromiter((len(x) for x in found), np.int64, len(found))
        pool = np.concatenate([*found, np.empty(0, np.uint32)])
        at = np.cumsum(size) - size
        sizes = size[which]
        counts = np.diff(np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]) + 1
        bounds = np.append(0, np.cumsum(counts))
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[bounds[1:] - 1] = False
        out[inner] = pool[kit.ragged(at[which], sizes)]
        return out, bounds


_units: UnitIds | None = None


def unit_ids(path: str) -> UnitIds:
    """This worker's table of units, kept from task to task."""
    global _units
    if _units is None or _units.path != path:
        _units = UnitIds(path)
    return _units


# -- placement ------------------------------------------------------------------------------------------------


class Packer:
    """Windows of one task. A piece is (document, start, length); pieces of a window lie one behind the other."""

    def __init__(self, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS):
        self.capacity, self.most = capacity, open_windows
        self.levels = np.zeros(capacity + 1, np.int64)  # partially filled windows at each fill level
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(capacity)]
        self.n_open = self.next = 0
        self.full: list[tuple[int, list]] = []  # windows ready to be written

    def level(self, size: int) -> int:
        """The fill level, 0 for a new window, whose use leaves the least sum of squared counts; ties to the fullest."""
        c = self.capacity
        now = self.levels[: c - size + 1]
        change = 2 * self.levels[size:] + 1  # the level reached counts one window more
        change[-1] = 0  # unless the window is full
        change[1:] += np.where(now[1:] > 0, 1 - 2 * now[1:], 1 << 60)  # the level left counts one less
        return c - size - int(np.argmin(change[::-1]))

    def put(self, window: int, pieces: list, fill: int) -> None:
        if fill == self.capacity:
            self.full.append((window, pieces))
            return
        self.open[fill].append((window, pieces))
        self.levels[fill] += 1
        self.n_open += 1

    def take(self, level: int) -> tuple[int, list]:
        if not level:
            self.next += 1
            return self.next - 1, []
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def add(self, doc, n: int) -> None:
        """A document of n tokens: whole windows first, the rest where the squares say."""
        start = 0
        while n - start >= self.capacity:
            self.put(*self.take(0)[:1], [(doc, start, self.capacity)], self.capacity)
            start += self.capacity
        if start < n:
            at = self.level(n - start)
            window, pieces = self.take(at)
            pieces.append((doc, start, n - start))
            self.put(window, pieces, at + n - start)
            if self.n_open > self.most:
                self.compact()

    def compact(self) -> None:
        """Fills the fullest open windows from the emptiest, whose pieces are cut to size; one may stay open."""
        held = [(level, *w) for level in range(1, self.capacity) for w in self.open[level]]
        self.open = [[] for _ in range(self.capacity)]
        self.levels[:] = 0
        self.n_open = 0
        low, high = 0, len(held) - 1
        while low < high:
            fill, window, pieces = held[high]
            left, donor, parts = held[low]
            doc, start, n = parts.pop()
            gap = self.capacity - fill
            if n > gap:
                parts.append((doc, start, n - gap))
                start, n = start + n - gap, gap
            pieces.append((doc, start, n))
            held[high], held[low] = (fill + n, window, pieces), (left - n, donor, parts)
            if fill + n == self.capacity:
                self.put(window, pieces, self.capacity)
                high -= 1
            if left == n:
                low += 1
        if low == high:
            fill, window, pieces = held[low]
            self.put(window, pieces, fill)

    def finish(self) -> None:
        """No window is left open: the last one is cut into windows at powers of two, which need no padding."""
        self.compact()
        last = next(((fill, self.open[fill].pop()) for fill in range(1, self.capacity) if self.open[fill]), None)
        self.levels[:] = 0
        self.n_open = 0
        if not last:
            return
        fill, (window, pieces) = last
        pieces.reverse()
        for bit in reversed(range(fill.bit_length())):
            room, mine = fill & (1 << bit), []
            while room:
                doc, start, n = pieces.pop()
                if n > room:
                    pieces.append((doc, start + room, n - room))
                    n = room
                mine.append((doc, start, n))
                room -= n
            if mine:
                self.full.append((window, mine))
                window = self.next
                self.next += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """The pieces of all sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of the sequence), and ids.

    docs: doc_id and text, others are left alone. A document is its ids and `end_id`. Every task packs its own rows in
    one pass, online: whole windows of a long document, then the rest into the open window whose fill level leaves the
    least sum of squared counts of partially filled windows. What is open at the end, or beyond `open_windows`, is
    filled up by cutting, and the last window of a task is cut into powers of two: nothing is padded. Sequence ids hold
    the task's number, so they are unique; a frame whose rows can change places between runs must be written before.
    Null and empty texts are the end id alone, repeated rows and null ids are packed like any, texts of any length go
    whole, and an empty table gives no pieces.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches, out):
        known, packer = unit_ids(tokenizer), Packer(capacity, open_windows)
        base = TaskContext.get().partitionId() << 40

        def written():
            for a in range(0, len(packer.full), 4096):
                some = packer.full[a : a + 4096]
                flat = [(doc, s, n, base + window, at) for window, pieces in some for (doc, s, n), at in zip(pieces, np.cumsum([0] + [p[2] for p in pieces[:-1]]).tolist(), strict=True)]
                fills = [(sum(p[2] for p in pieces), len(pieces)) for _, pieces in some]
                pad = np.repeat([0 if fill & (fill - 1) == 0 else capacity - fill for fill, _ in fills], [k for _, k in fills])
                parts = [d[1][s : s + n] for d, s, n, _, _ in flat]
                columns = [pa.array([d[0] for d, *_ in flat], pa.int64()), [x[1] for x in flat], [x[2] for x in flat], [zlib.crc32(p) for p in parts], [len(d[1]) for d, *_ in flat], [x[3] for x in flat], [x[4] for x in flat], pad]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])), pa.int32()), pa.array(np.concatenate(parts).view(np.int32))))
                yield kit.record(out, columns)
            packer.full = []

        for batch in batches:
            for some, data, offsets in kit.chunks(batch):
                ids, bounds = known.ids(data, offsets, end_id)
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    # a copy of its own for a document that stays open, so that it does not hold its whole chunk
                    packer.add((doc_id, ids[a:b].astype("<u4")), b - a)
                yield from written()
        packer.finish()
        yield from written()

    return kit.mapped(rows, run, SCHEMA + (", ids array<int>" if with_ids else ""))


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    return packed(docs, tokenizer, with_ids=False).drop("padding")
