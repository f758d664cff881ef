"""Packing: placement against a plain sum-of-squares packer, ids against the tokenizer, and the pieces against the documents."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import rows

from fundlens.llm import catalog, packing


def plain_level(levels, size, capacity):
    """The level that leaves the least sum of squares, by trying all; ties to the fullest."""
    best = None
    for at in range(capacity - size, -1, -1):
        if at and not levels[at]:
            continue
        after = dict(levels)
        if at:
            after[at] -= 1
        if at + size < capacity:
            after[at + size] = after.get(at + size, 0) + 1
        total = sum(v * v for v in after.values())
        if best is None or total < best[0]:
            best = (total, at)
    return best[1]


@pytest.mark.parametrize("capacity, sizes", [(10, range(1, 10)), (64, range(1, 200)), (100, (50, 60, 34, 33)), (16, (9,))])
def test_placement(capacity, sizes):
    rng = random.Random(3)
    packer, levels = packing.Packer(capacity), defaultdict(int)
    for _ in range(400):
        size = rng.choice(list(sizes))
        rest = size % capacity
        if rest:
            at = packer.level(rest)
            assert at == plain_level(levels, rest, capacity)
            levels[at] -= at > 0
            levels[at + rest] += at + rest < capacity
        packer.add("d", size)
        assert [packer.levels[k] for k in range(1, capacity)] == [levels[k] for k in range(1, capacity)]
        assert sum(packer.levels) == packer.n_open == sum(map(len, packer.open))


@pytest.mark.parametrize("most", [3, 1000])
def test_windows_are_full_or_powers_of_two(most):
    rng = random.Random(5)
    packer, docs = packing.Packer(32, most), [rng.choice([1, 9, 17, 20, 31, 32, 33, 100]) for _ in range(700)]
    for i, n in enumerate(docs):
        packer.add(i, n)
        assert packer.n_open <= most
    packer.finish()
    assert packer.n_open == 0 and len({w for w, _ in packer.full}) == len(packer.full)
    covered = defaultdict(list)
    for _, pieces in packer.full:
        fill = sum(n for _, _, n in pieces)
        assert fill <= 32 and fill & (fill - 1) == 0
        for doc, start, n in pieces:
            covered[doc] += range(start, start + n)
    assert all(sorted(covered[i]) == list(range(n)) for i, n in enumerate(docs))
    assert sum(sum(p[2] for p in pieces) < 32 for _, pieces in packer.full) <= 5


TRICKY = ["a  b", " a", "a ", "a  b", "é b", "　 x", "x  y", "it's  don't 's", "<|endoftext|> a <|endoftext|>", "1 2,3  .\n\n x\r\n\ty", "\x85 a", "漢字 かな", "à è é ù", "a\x0b b\x0c c\x1f d", "😀 😀  😀", "\n", " " * 50]


def test_ids_of_units_are_ids_of_the_text(documents):
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path("byte_bpe_50k.json")
    tokenizer, units = Tokenizer.from_file(path), packing.UnitIds(path)
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice([" ", "\n", " ", " ", "a", "B", "é", "漢", "'", "s", "1", ".", "\t"]) for _ in range(60)) for _ in range(200)] + [r["text"] or "" for r in rows(documents)]
    flat = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(flat), np.uint8), np.append(0, np.cumsum([len(t) for t in flat]))
    for _ in range(2):  # unknown, then remembered
        ids, bounds = units.ids(data, offsets, 0)
        for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_pieces_of_all_documents(spark, documents, odd, empty, clashing):
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs in (documents.repartition(3), odd, empty, clashing):
        docs = docs.select("doc_id", "text")
        got = rows(packing.packed(docs, path))
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] > 0
        for pieces in by_sequence.values():
            pieces.sort(key=lambda r: r["offset"])
            ends = np.cumsum([r["length"] for r in pieces]).tolist()
            assert [r["offset"] for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 1024 and ends[-1] & (ends[-1] - 1) == 0
            assert all(r["padding"] == 0 for r in pieces)
        want = defaultdict(list)
        for r in rows(docs):
            want[r["doc_id"]].append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0])
        assert sorted(map(str, want)) == sorted(map(str, by_doc))
        for doc, texts in want.items():
            if len(texts) == 1:
                pieces = sorted(by_doc[doc], key=lambda r: r["start"])
                assert [x for r in pieces for x in r["ids"]] == texts[0] and {r["doc_tokens"] for r in pieces} == {len(texts[0])}
            else:
                assert sum(r["length"] for r in by_doc[doc]) == sum(map(len, texts))
        short = rows(packing.report(docs, path))
        assert len(short) == len(got) and set(short[0] if short else ()) <= set(got[0] if got else ())
