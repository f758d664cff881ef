"""SimHash groups and decontamination against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import rows

from fundlens.llm import decontaminate, simhash
from fundlens.llm.components import components


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_groups(prints, bits=3):
    """prints: (id, fingerprint) -> smallest id reachable, by all pairs."""
    fps = sorted({f for _, f in prints})
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for d, f in prints:
        r = find(fps.index(f))
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return {f: least[find(i)] for i, f in enumerate(fps)}


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_groups(request, name):
    docs = request.getfixturevalue(name)
    prints = [(r["doc_id"], expected_print(r["text"])) for r in rows(docs)]
    roots = expected_groups(prints)
    want = sorted((str(d), f"{f:016x}", str(roots[f])) for d, f in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows(simhash.groups(docs))) == want


@pytest.mark.parametrize("bits", [3, 6])
def test_links_in_crowded_buckets(spark, monkeypatch, bits):
    """Thousands of fingerprints around a few centres: the same components as all pairs give, from few links."""
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(20, 50), rng.randrange(6))) for c in centres for _ in range(400)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    monkeypatch.setattr(simhash, "TILE", 64)
    found = simhash.links(spark.createDataFrame(signed, "_fp long"), bits).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits for r in found)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        a, b = find(r.a % (1 << 64)), find(r.b % (1 << 64))
        parent[max(a, b)] = min(a, b)
    want = expected_groups([(f, f) for f in fps], bits)
    assert {f: find(f) for f in fps} == want


def test_near_pairs_lose_nothing():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) for _ in range(8)])
    for other in (None, fps[::-1].copy()):
        i, j = simhash.near_pairs(fps, other)
        o = fps if other is None else other
        want = {(a, b) for a in range(len(fps)) for b in range(len(o)) if (other is not None or a < b) and int(fps[a] ^ o[b]).bit_count() <= 3}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_components_of_chains_stars_and_rings(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    random.Random(3).shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)} | {2000 + i: 2000 for i in range(1, 9)}
    assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(documents, odd, clashing, empty):
    for docs in (documents, odd, clashing, empty):
        found = {(r["doc_id"], r["component_id"]) for r in rows(simhash.groups(docs.select("doc_id", "text")))}
        kept = simhash.deduplicated(docs)
        assert kept.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in rows(kept)) == sorted({str(c) for _, c in found})


def distinct_texts(n):
    rng = random.Random(9)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(n)]


def test_groups_of_null_and_repeated_ids_keep_a_row_each(spark):
    a, b, c, d, e, f = distinct_texts(6)
    docs = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (7, e), (8, d), (3, f), (None, f)]
    got = simhash.deduplicated(spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string").repartition(3))
    want = [(None, a), (None, b), (None, c), (7, d), (7, e), (3, f)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows(got)) == sorted((str(i), t) for i, t in want)


# -- decontamination ------------------------------------------------------------------------------------------


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def expected_report(docs, items):
    windows = {}
    for name, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add("null" if name is None else str(name))
    lengths = {len(k) for k in windows}
    out = []
    for r in docs:
        w, hit, found = item_words(r["text"]), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((str(r["doc_id"]), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
@pytest.mark.parametrize("block", [1 << 20, 600])
def test_report(spark, request, name, block, monkeypatch):
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (block,))
    monkeypatch.setattr(decontaminate.matches, "__defaults__", (13, block))
    docs = request.getfixturevalue(name)
    passage = " ".join(f"word{i % 977} of{i % 31}" for i in range(50, 90))
    items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))]
    items += [(1000, "one two"), (1001, None), (1002, ""), (1003, " !? "), (None, "same row"), (1004, passage.upper()), (1004, passage), (1005, passage + " x"), (1006, "word5")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs, benchmark)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(got)) == expected_report(rows(docs), items)


def test_no_benchmark_and_clashing_names(spark, odd, clashing):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in rows(decontaminate.report(odd, nothing))} == {0}
    kept = decontaminate.clean(clashing, spark.createDataFrame([(1, "number 3 with")], "item_id long, text string"))
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in rows(kept)) == [0, 1, 2, 4, 5]


def test_suffixes_are_in_order():
    rng = np.random.default_rng(4)
    words, bounds = rng.integers(1, 4, 400).astype(np.uint64), np.array([0, 150, 151, 400])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(400)
    order = decontaminate.suffix_array(words, left, 13)
    keys = [tuple(words[p : p + min(left[p], 16)].tolist()) for p in order]
    assert sorted(order.tolist()) == list(range(400)) and all(a[:13] <= b[:13] for a, b in zip(keys, keys[1:], strict=False))
