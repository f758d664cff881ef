"""Near-duplicates by shingles against all pairs."""

import random
import re

import corpus_pipeline
import pytest
from conftest_llm import rows

from fundlens.llm import shingles


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(docs):
    """(id, shingle set) of the row that stays of each group."""
    sets = list({s for _, s in docs})
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    place, least = {s: i for i, s in enumerate(sets)}, {}
    for d, s in docs:
        key = (d is None, d or 0)
        r = find(place[s])
        least[r] = min(least.get(r, key), key)
    return sorted(str(None if none else d) for none, d in least.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def near_copies():
    """Groups at all similarities around 0.8, with a line that all texts share, null ids and chains of edits."""
    rng = random.Random(11)
    line = "all texts of this source end with one and the same long footer line".split()
    docs = []
    for g in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(8):
            docs.append(" ".join(edited(rng, base, rng.randrange(len(base) // 12 + 1)) + line))
            if g % 3 == 0:
                base = edited(rng, base, 1)
    return [(None if k % 7 == 3 else k // 2, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("common_from", [4, 10**6])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, common_from):
    monkeypatch.setattr(shingles, "COMMON_FROM", common_from)
    docs = near_copies()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")
    want = expected([(d, shingle_set(t)) for d, t in docs])
    assert 12 < len(want) < len(docs) and sorted(str(r["doc_id"]) for r in rows(got)) == want


def test_stage_on_odd_tables(documents, odd, empty, clashing, spark):
    for docs in (documents, odd, empty, clashing):
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in rows(got)) == expected([(r["doc_id"], shingle_set(r["text"])) for r in rows(docs)])


@pytest.mark.parametrize("hot, tile, spread", [(2, 3, 2), (10**6, 3, 10**6)])
def test_hot_shingles_and_tiles(spark, monkeypatch, hot, tile, spread):
    monkeypatch.setattr(shingles, "COMMON_FROM", 10**6)
    for name, value in (("HOT", hot), ("TILE", tile), ("SPREAD", spread)):
        monkeypatch.setattr(shingles, name, value)
    docs = near_copies()
    got = shingles.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(str(r["doc_id"]) for r in rows(got)) == expected([(d, shingle_set(t)) for d, t in docs])


def test_unlike_texts_that_share_a_line_make_few_pairs(spark, monkeypatch):
    """The sample shows nothing, yet the line goes to the end of the order once it is seen to be held by many."""
    monkeypatch.setattr(shingles, "SAMPLE_TEXTS", 0)
    rng = random.Random(3)
    line = "one rare line that very many quite unlike texts of this table share"
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " " + line) for i in range(20_000)], "doc_id long, text string").repartition(8)
    rows_, names = shingles.simhash.keyed(docs)
    one = shingles.sets(shingles.simhash.texts(rows_, names)).where("s is not null").select("_fp", "s").cache()
    found = shingles.met(one)
    assert found.groupBy("t").count().agg({"count": "max"}).first()[0] <= shingles.HOT
    assert shingles.deduplicated(docs).count() == 20_000


def test_tables_on_the_way_are_deleted(spark, documents):
    from pathlib import Path

    from fundlens.llm import kit

    folder = Path(kit.shared_dir(spark))
    before = set(folder.iterdir())
    assert shingles.deduplicated(documents).count() > 0
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"keep"}


def test_simhash_links_are_checked_by_the_sets(spark):
    """Fingerprints are those of the majority of bits, near copies are linked by them, and no link below the similarity stays."""
    import numpy as np

    s = np.array([1, 3, 7, -1], np.int64)
    assert shingles.fingerprint(s) == 0b11 and shingles.fingerprint(s[:0]) == 0
    rng = random.Random(5)
    bases = [[f"v{rng.randrange(10**6)}" for _ in range(400)] for _ in range(6)]
    docs = [(10 * g + k, " ".join(edited(rng, base, k and 1))) for g, base in enumerate(bases) for k in range(3)]
    keyed, names = shingles.simhash.keyed(spark.createDataFrame(docs, "doc_id long, text string"))
    maps = shingles.sets(shingles.simhash.texts(keyed, names), "m").select("_fp", "m", "doc_id").cache()
    ids = {r["_fp"]: r["doc_id"] for r in rows(maps)}
    found = rows(shingles.fingerprinted(maps.select("_fp", "m")))
    assert found and all(ids[r["a"]] // 10 == ids[r["b"]] // 10 for r in found)
    assert shingles.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).count() == 6


def test_a_large_group_around_the_similarity_makes_few_pairs(spark, monkeypatch):
    """Pairs that are sent to be compared grow with the sets, not with the square of the group."""
    rng = random.Random(17)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(i, " ".join(edited(rng, base, rng.randrange(1, 4)))) for i in range(400)]
    compared, plain = [], shingles.verified

    def verified(pairs, one, maps):
        compared.append(pairs.count())
        return plain(pairs, one, maps)

    monkeypatch.setattr(shingles, "verified", verified)
    got = shingles.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(str(r["doc_id"]) for r in rows(got)) == expected([(d, shingle_set(t)) for d, t in docs])
    assert sum(compared) < 10 * len(docs)


def test_parity_maps_tell_large_sets_apart(spark, monkeypatch):
    """Long unlike texts that share some lines make no pairs, whatever the number of their shingles; a pair of a task comes once."""
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m in ((5, 5), (300, 310), (1500, 1400), (6000, 5000), (70_000, 69_000)):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        near, far = np.unique(np.append(a[: m - m // 20], rng.integers(-(1 << 62), 1 << 62, m // 20))), np.unique(rng.integers(-(1 << 62), 1 << 62, m))
        maps = np.empty(3, object)
        maps[:] = [shingles.parity_map(x) for x in (a, near, far)]
        found = shingles.alike_by_parity(maps)(np.array([len(a), len(near), len(far)]), np.array([0, 0, 1]), np.array([1, 2, 2]))
        assert found[0] and (n > 1 << 15 or not found[1:].any())  # beyond that size maps are bounded and tell less
    monkeypatch.setattr(shingles, "SAMPLE_TEXTS", 0)
    words = random.Random(8)
    line = " ".join(f"shared{i}" for i in range(40))
    texts = [" ".join(f"w{words.randrange(10**7)}" for _ in range(1500)) + " " + line for _ in range(40)]
    texts.append(texts[0].replace(texts[0].split()[700], "changed"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    keyed, names = shingles.simhash.keyed(docs)
    given = shingles.simhash.texts(keyed, names)
    maps = shingles.sets(given, "m").select("_fp", "m").cache()
    rows_ = shingles.met(shingles.sets(given).select("_fp", "s"))
    some = shingles.unjoined(rows_, rows_.select(rows_._fp.alias("a"), rows_._fp.alias("b")))
    assert some.count() > 100
    pairs = shingles.meetings(some, maps)
    assert pairs.distinct().count() == 1 and pairs.count() <= shingles.kit.width(spark)
    assert shingles.deduplicated(docs).count() == 40
