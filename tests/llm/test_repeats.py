"""Removal of repeated strings against a plain scan of all strings."""

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import rows

from fundlens.llm import kit, repeats


def expected(docs, length=100):
    first, out = {}, []
    order = sorted(range(len(docs)), key=lambda i: (docs[i]["doc_id"] is not None, docs[i]["doc_id"] or 0))
    place = lambda i, p: (docs[i]["doc_id"] is not None, docs[i]["doc_id"] or 0, p)
    texts = [(r["text"] or "").encode() for r in docs]
    for i in order:
        for p in range(len(texts[i]) - length + 1):
            s = texts[i][p : p + length]
            first[s] = min(first.get(s, place(i, p)), place(i, p))
    for i in order:
        t = texts[i]
        keep = bytearray(b"\1" * len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < place(i, p):
                keep[p : p + length] = bytes(length)
        left = bytes(c for c, k in zip(t, keep, strict=True) if k)
        n_spans = sum(1 for j in range(len(t)) if not keep[j] and (j == 0 or keep[j - 1]))
        out.append((str(docs[i]["doc_id"]), len(t), len(t) - len(left), n_spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(df))


@pytest.fixture(scope="module")
def tangled(spark):
    """Near copies, shared passages at odd places, overlapping repeats inside a text, runs of one letter, a common line."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, line, passage = text(400), text(15)[:99], text(60)
    out = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            w = base.split()
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 1:
            t = text(30) + passage[rng.randrange(40) :] + text(20)
        elif kind == 2:
            t = base
        elif kind == 3:
            t = text(5) + "x" * rng.randrange(90, 300) + text(5) + "xy" * 120
        elif kind == 4:
            t = "\n".join(text(8) + "\n" + line + "." for _ in range(4))
        else:
            t = (passage + " ") * 3 + text(10)
        out.append((rng.randrange(-5, 50), t))
    return spark.createDataFrame([(None, base), *out], "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("name", ["documents", "odd", "empty", "tangled"])
def test_report(request, name):
    docs = request.getfixturevalue(name)
    if name == "documents":
        docs = docs.where("length(text) < 20000")
    assert got(repeats.report(docs)) == expected(rows(docs.select("doc_id", "text")))


def test_small_blocks_pieces_and_sends(tangled, monkeypatch):
    """Cuts into blocks, pieces and sends change nothing."""
    for name, value in (("PIECE", 150), ("BLOCK_BYTES", 4000), ("HELD", 50)):
        monkeypatch.setattr(repeats, name, value)
    docs = tangled.where("abs(doc_id) % 3 < 2")
    assert got(repeats.report(docs)) == expected(rows(docs))
    text = np.arange(1000, dtype=np.uint8)
    assert [a + s for a, p in repeats.pieces(text, 150) for s in range(len(p) - 99)] == list(range(901))


def test_ranks_place_equal_strings_alike():
    rng = np.random.default_rng(1)
    common = rng.integers(97, 100, 260, dtype=np.uint8)
    a = np.concatenate([rng.integers(97, 100, 333, dtype=np.uint8), common, rng.integers(97, 100, 50, dtype=np.uint8)])
    b = np.concatenate([rng.integers(97, 100, 80, dtype=np.uint8), common, rng.integers(97, 100, 400, dtype=np.uint8)])
    under = []
    for x in (a, b):
        r = repeats.Ranks(x)
        assert r.first[0] == 0 and r.last[-1] == len(x) - 100 and (r.first[1:] == r.last[:-1] + 1).all()
        name = np.repeat(r.name, r.last - r.first + 1)
        under.append({bytes(x[s : s + 100]): (int(name[s]), int(v)) for s, v in zip(range(len(name)), r.strings(np.arange(len(name))), strict=True)})
    both = under[0].keys() & under[1].keys()
    assert len(both) >= 161 and all(under[0][s] == under[1][s] for s in both)
    assert len({v for _, v in under[0].values()}) == len(under[0])


def test_spans_join_where_they_touch():
    ref, start, end = repeats._union(np.array([2, 1, 1, 1, 2]), np.array([5, 0, 10, 30, 5]), np.array([9, 10, 12, 40, 7]))
    assert list(zip(ref.tolist(), start.tolist(), end.tolist(), strict=True)) == [(1, 0, 12), (1, 30, 40), (2, 5, 9)]


def test_sliding_lowest():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 64, 69, 128, 200):
        assert repeats._sliding(x, w, np.minimum).tolist() == [int(x[i : i + w].min()) for i in range(200 - w + 1)]
    assert len(kit.ragged(np.array([3, 9]), np.array([0, 2]))) == 2
