"""Language, quality and toxicity models, the language model and top-k search: held-out accuracy, brute force, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import rows

from fundlens.llm import gru, langid, lm, quality, topk, toxicity


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def larger(spark):
    return {n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels")}


# -- languages ------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(larger):
    truth = {r["doc_id"]: r["lang"] for r in rows(larger["documents"])}
    got = rows(langid.report(larger["documents"]))
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, empty):
    got = {str(r["doc_id"]): r for r in rows(langid.report(odd))}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in "1236")
    assert got["10"]["lang_pred"] in {"en", "de", "fr", "es"} and rows(langid.report(empty)) == []


def test_filters_hold_all_languages_of_an_ngram(spark):
    """More than 64 languages: masks of two words, every gram that a language learned is in its mask, false positives are corrected."""
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}zq " * 40, f"l{i:02}") for i in range(70)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.filters) == 2 and len(model.false) == 70
    got = {r["doc_id"]: r["_lang"] for r in rows(langid.predicted(docs.select("doc_id", "text"), model))}
    assert got == {i: f"l{i:02}" for i in range(70)}


def test_grams_do_not_cross_texts():
    data = np.frombuffer(b"abcd!ef", np.uint8)
    gram, bounds = langid.grams(data, np.array([0, 4, 5, 7]))
    texts = [{int(g).to_bytes(4, "little").decode() for g in gram[a:b]} for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert texts[0] == {"   a", "  ab", " abc", "abcd", "bcd ", "cd  ", "d   "} and texts[1] == set() and texts[2] == {"   e", "  ef", " ef ", "ef  ", "f   "}


# -- quality --------------------------------------------------------------------------------------------------


def test_sample_keeps_good_documents(larger):
    truth = {r["doc_id"]: r["quality"] for r in rows(larger["labels"])}
    got = rows(quality.resampled(larger["documents"], larger["labels"]))
    assert len(got) == larger["documents"].count()
    known = [(truth[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in truth]
    good, poor = [k for q, k in known if q == 1], [k for q, k in known if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.05 * len(poor)
    kept = quality.filtered(larger["documents"], larger["labels"])
    assert kept.columns == larger["documents"].columns and {r["doc_id"] for r in rows(kept)} == {r["doc_id"] for r in got if r["kept"]}


def test_gumbel_top_k_takes_k(larger):
    got = rows(quality.resampled(larger["documents"], larger["labels"], keep=0.3))
    taken = sorted((r["sample_key"] for r in got if r["kept"]), reverse=True)
    assert len(taken) == 300 and taken[-1] > max(r["sample_key"] for r in got if not r["kept"])
    assert rows(quality.resampled(larger["documents"].repartition(7), larger["labels"], keep=0.3).where("kept").orderBy("doc_id")) == sorted((r for r in got if r["kept"]), key=lambda r: r["doc_id"])


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = [*rng.integers(-(1 << 62), 1 << 62, 200).tolist(), 0, 0, -1, 7, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 103, len(values)):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_quality_of_odd_rows(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, None), (9, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    assert len(rows(quality.resampled(odd, labels))) == odd.count()
    assert {r["kept"] for r in rows(quality.resampled(odd, none))} == {True}
    assert rows(quality.resampled(empty, labels)) == [] and rows(quality.filtered(empty, none)) == []
    assert quality.filtered(clashing, none).columns == clashing.columns


# -- toxicity -------------------------------------------------------------------------------------------------


def test_toxicity_of_held_out_documents(larger):
    truth = {r["doc_id"]: r["toxic"] for r in rows(larger["labels"])}
    got = rows(toxicity.report(larger["documents"], larger["labels"]))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) >= 0.75 * len(pos) * len(neg)


def test_telling_strings_of_texts_with_common_lines_and_many_slurs():
    """A header that all texts share hides none of them; rare and many telling words all come into the dictionary."""
    letters = "abcdefghijklmnopqrst"
    bad = [f"grumph{a}{b}zork" for a in letters for b in letters]
    header = "this line stands at the head of every text of this one source " * 2
    texts = [(f"{header}plain text number {letters[i % 20] * 3} {letters[i // 20 % 20] * 4} {letters[i // 400] * 5}", 0) for i in range(1200)]
    texts += [(f"{header}{bad[i % 400]} and {bad[(i + 1) % 400]} {letters[i // 400] * 6}", 1) for i in range(1600)]
    found = b"".join(toxicity.telling_strings(texts))
    assert sum(w.encode() in found for w in bad) == 400 and b"every text" not in found


def held_out_auc(got, truth):
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    pos, neg = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)


def test_near_copies_of_toxic_texts_teach_once(spark):
    """Fifteen texts of each class in ten near copies each: held-out accuracy stays within 0.1 of the clean run."""
    at = {n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels")}
    docs, labels = at["documents"].join(at["labels"].select("doc_id"), "doc_id"), at["labels"]
    truth = {r["doc_id"]: r["toxic"] for r in rows(labels) if r["toxic"] is not None}
    learning = [r for r in rows(docs.join(labels, "doc_id")) if zlib.crc32(str(r["doc_id"]).encode()) % 5 and len((r["text"] or "").split()) > 60]
    base = [r for y in (0, 1) for r in [x for x in learning if x["toxic"] == y][:15]]
    free = iter(i for i in range(10**6, 10**7) if zlib.crc32(str(i).encode()) % 5)
    copies = []
    for r in base:
        words = r["text"].split(" ")
        for k in range(10):
            copies.append((next(free), " ".join([*words[: k + 1], f"edit{k}", *words[k + 1 :]]), r["toxic"]))
    more = spark.createDataFrame(copies, "doc_id long, text string, toxic long")
    clean = held_out_auc(rows(toxicity.report(docs, labels)), truth)
    copied = held_out_auc(rows(toxicity.report(docs.select("doc_id", "text").union(more.select("doc_id", "text")), labels.select("doc_id", "toxic").union(more.select("doc_id", "toxic")))), truth)
    assert clean > 0.85 and copied > clean - 0.1


def test_one_of_each_group_of_alike_texts():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 1 << 60, toxicity.SKETCH, dtype=np.uint64) for _ in range(3))
    near = np.where(np.arange(toxicity.SKETCH) < 80, a, c)
    got = toxicity.one_of_each([5, 4, 9, 7, 1], [1, 1, 1, 1, 0], np.array([a, near, b, c, a]))
    assert set(got) == {4, 9, 7, 1} and set(got.values()) <= {0, 1}
    assert toxicity.one_of_each([], [], np.empty((0, toxicity.SKETCH), np.uint64)) == {}


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(rows(toxicity.report(odd, labels))) == odd.count()
    assert {r["score"] for r in rows(toxicity.report(odd, labels.where("false")))} == {0.0}
    assert rows(toxicity.report(empty, labels)) == []


def test_windows_cover_the_text():
    text = "One two, three " * 50 + "x" * 1000
    assert b"".join(toxicity.windows(text)).split() == [b"one", b"two", b"three"] * 50 + [b"x" * 1000]
    assert toxicity.windows(None) == [] == toxicity.windows("123 !")


# -- language model -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_counts_and_base_scores(request, monkeypatch, name, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    docs = rows(request.getfixturevalue(name))
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])) for r in docs]
    held = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2 for r in docs]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 5)) for r, w, h in zip(docs, words, held, strict=True))
    got = rows(lm.report(request.getfixturevalue(name)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_recurrent_model_beats_counts(larger):
    got = [r for r in rows(lm.report(larger["documents"])) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.98


def test_every_block_trains_on_all_its_documents(spark, monkeypatch):
    """Many small blocks: the own word of each document that is not held out has moved."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    docs = spark.createDataFrame([(i, f"word{i} and some more words of text {i} " * 3) for i in range(60)], "doc_id long, text string").repartition(2)
    got = {}
    trained = lm.trained
    monkeypatch.setattr(lm, "trained", lambda blocks, corpus: got.setdefault("weights", trained(got.setdefault("blocks", blocks), got.setdefault("corpus", corpus))))
    assert lm.report(docs).count() == 60 and got["blocks"].count() > 10
    moved = (np.abs(gru.Net(got["weights"]).x - got["corpus"].net.x) > 1e-6).any(axis=1)
    assert len(got["corpus"].top_hashes) > 100 and moved[: len(got["corpus"].top_hashes) + 1].all()


def test_states_are_carried_and_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    net = gru.Net.fresh(np.full(gru.WORDS // gru.IN_CLASS + gru.RARE, 1 / (gru.WORDS // gru.IN_CLASS + gru.RARE)), np.full((gru.WORDS // gru.IN_CLASS, gru.IN_CLASS), 1 / gru.IN_CLASS))
    net.c[:], net.w[:] = rng.normal(0, 1, net.c.shape), rng.normal(0, 1, net.w.shape)
    bounds = np.array([0, 700, 701, 1500, 1530])
    words = rng.integers(0, gru.WORDS, 1530)
    cls, inside = words // gru.IN_CLASS, words % gru.IN_CLASS
    want = np.zeros(1530)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h, last = np.zeros((1, gru.HIDDEN), np.float32), 0
        for i in range(a, b):
            h, _ = net.step(np.array([last]), h)
            want[i], last = net.log_p(h, cls[i : i + 1], inside[i : i + 1])[0], words[i]
    for n in (1, 2, 64):
        assert np.allclose(gru.score(net, gru.Streams(words, bounds, n), cls, inside), want, atol=1e-3)
    k = gru.WORDS // gru.IN_CLASS
    h = np.repeat(rng.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32), gru.WORDS + gru.RARE, axis=0)
    all_words = np.arange(gru.WORDS)
    p = net.log_p(h, np.append(all_words // gru.IN_CLASS, k + np.arange(gru.RARE)), np.append(all_words % gru.IN_CLASS, np.full(gru.RARE, -1)))
    assert abs(np.exp(p).sum() - 1) < 1e-3


def test_gradients():
    rng = np.random.default_rng(4)
    net = gru.Net.fresh(np.full(gru.WORDS // gru.IN_CLASS + gru.RARE, 0.01), np.full((gru.WORDS // gru.IN_CLASS, gru.IN_CLASS), 0.02))
    net.flat[:] += rng.normal(0, 0.05, net.flat.shape).astype(np.float32)
    words = rng.integers(0, 70, 3 * gru.WINDOW)
    streams = gru.Streams(words, np.array([0, len(words)]), 1)
    first = gru.train(net, np.zeros_like(net.flat), streams, words // gru.IN_CLASS, words % gru.IN_CLASS)
    memory = np.zeros_like(net.flat)
    for _ in range(30):
        last = gru.train(net, memory, streams, words // gru.IN_CLASS, words % gru.IN_CLASS)
    assert last < 0.6 * first


def test_a_window_trains_as_a_plain_one_does():
    """Gradients of one window from numeric differences, by the squares that the memory gains; rows of any number of a word add up."""
    rng = np.random.default_rng(6)
    keys, values = np.append(rng.integers(0, 40, 300), np.zeros(50, int)), rng.normal(0, 1, (350, 3)).astype(np.float32)
    some, sums = gru._sums(values, keys)
    assert some.tolist() == sorted(set(keys.tolist())) and np.allclose(sums, [values[keys == k].sum(axis=0) for k in some], atol=1e-4)
    net = gru.Net.fresh(np.full(gru.WORDS // gru.IN_CLASS + gru.RARE, 0.01), np.full((gru.WORDS // gru.IN_CLASS, gru.IN_CLASS), 0.02))
    net.flat[:] += rng.normal(0, 0.3, net.flat.shape).astype(np.float32)
    words = rng.integers(0, 90, 20)
    words[-1] = 0
    streams, cls, inside = gru.Streams(words, np.array([0, 13, 17, 20]), 3), words // gru.IN_CLASS, np.where(words < 64, words % gru.IN_CLASS, -1)
    memory, trained = np.zeros_like(net.flat), gru.Net(net.flat.copy())
    assert gru.train(trained, memory, streams, cls, inside) > 0
    used = np.flatnonzero(memory > 1e-2)
    assert len(used) > 1000
    for k in rng.choice(used, 40, replace=False):
        ends = []
        for step in (1e-2, -1e-2):
            moved = net.flat.copy()
            moved[k] += step
            ends.append(-gru.score(gru.Net(moved), streams, cls, inside).sum())
        slope = (ends[0] - ends[1]) / 2e-2 * gru.WINDOW / len(words)
        assert abs(slope**2 - memory[k]) < 0.05 * memory[k] + 1e-3
        assert np.sign(slope) == np.sign(net.flat[k] - trained.flat[k])


def test_last_windows_train():
    """Lanes of any length: every input leaves a trace, that of a padded lane is the one it leaves alone."""
    def memory_of(*sizes):
        net = gru.Net.fresh(np.full(gru.WORDS // gru.IN_CLASS + gru.RARE, 0.01), np.full((gru.WORDS // gru.IN_CLASS, gru.IN_CLASS), 0.02))
        rng = np.random.default_rng(1)
        net.c[:], net.w[:] = rng.normal(0, 1, net.c.shape), rng.normal(0, 1, net.w.shape)
        memory, words = np.zeros_like(net.flat), np.concatenate([np.arange(1, n + 1) + 100 * k for k, n in sizes])
        bounds = np.append(0, np.cumsum([n for _, n in sizes]))
        loss = gru.train(net, memory, gru.Streams(words, bounds, len(sizes)), words // gru.IN_CLASS, words % gru.IN_CLASS)
        assert loss > 0
        return np.sqrt(gru.Net(memory).x)

    for n in (2, 15, 17, 40):
        assert memory_of((1, n))[101 : 100 + n].any(axis=1).all()
    both, alone = memory_of((1, 10), (2, 4)), memory_of((2, 4))
    assert np.allclose(both[201:204] * 14, alone[201:204] * 4, rtol=1e-3, atol=1e-6) and alone[201:204].any(axis=1).all()


# -- top-k ----------------------------------------------------------------------------------------------------


def expected_top(vectors, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in reversed(ok)}.items()):
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("block", [8192, 3])
def test_top_k_of_test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "SHARD", 60)
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = topk.search(vectors, vectors.where("vec_id % 50 = 0"), block=block)
    assert sorted(map(tuple, got.collect())) == expected_top([(r["vec_id"], r["embedding"]) for r in rows(vectors)])


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(6)
    some = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(1, 120)]
    sparse = [(200 + i, [0.0] * i + [1.0]) for i in range(5)]
    odd = [(0, [0.5, -1.0, 0, 0, 2.0, 1.0]), (50, None), (100, [1.0, None, 0, 0, 0, 0]), (150, [float("nan")] * 6), (None, [1.0] * 6), (250, [-1.0, 0.0]), (300, []), (300, [])]
    vectors = [v for v in some if v[0] not in (50, 100)] + sparse + odd
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(5)
    assert sorted(map(tuple, topk.report(df).collect())) == sorted(expected_top(vectors))
    assert topk.report(df.where("false")).collect() == []
    few = df.where("vec_id in (0, 1, 2)")
    assert [r["rank"] for r in topk.report(few).orderBy("rank").collect()] == [1, 2]


def test_top_k_of_dirty_and_repeated_queries(spark):
    """A bad row of a query id hides no good one, and both good rows of an id are asked."""
    vectors = [(50, [None, 1.0]), (50, [2.0, 1.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0]), (100, [0.0, 1.0]), (100, [-1.0, 0.0]), (150, [float("inf"), 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.report(df).collect()))
    unit = 256 * 256
    assert got[:4] == [(50, 1, 2, 6 * unit), (50, 2, 1, 2 * unit), (50, 3, 100, unit), (50, 4, 100, -2 * unit)]
    assert [r[2:] for r in got[4:]] == [(50, unit), (1, 0), (2, 0), (1, -unit), (50, -2 * unit)] and {r[0] for r in got[4:]} == {100}


@pytest.mark.parametrize("block", [1, 8192])
def test_top_k_of_huge_components(spark, block):
    """floor(256 x) is exact at any size; only a score beyond a long is held to it."""
    huge = [(50, [600_000.0, 3.0]), (100, [700_000.0, 1.0]), (1, [2.0**40, 1.0]), (2, [1e300, 0.0]), (3, [-(2.0**60), 5.0]), (4, [0.25, -0.5]), (150, [1e17, 1.5])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>").repartition(2)
    exact = {i: [int(x) * 256 if abs(x) > 2**50 else math.floor(256 * x) for x in v] for i, v in huge}
    want = []
    for q in (50, 100, 150):
        scored = sorted((-max(min(sum(a * b for a, b in zip(exact[q], v, strict=True)), 2**63 - 1), -(2**63)), i) for i, v in exact.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0"), block=block).collect())) == sorted(want)


def test_threshold_rises_and_postings_stay_unread():
    """With one strong dimension most vectors are never weighed."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.permutation(5000) * 1000, rng.integers(-3, 4, (5000, 7))])
    shard = topk.Shard(np.arange(5000), x)
    query = np.array([1000, 1, 2, -1, 1, 0, 2, 1])
    weighed, plain = [], shard.x

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                weighed.append(key.size / 8)
                return np.asarray(super().__getitem__(key))
            return super().__getitem__(key)

    shard.columns = shard.columns.view(Counted)
    rows_, scores = shard.top(query, None, 5)
    best = np.lexsort((np.arange(5000), -(plain @ query)))[:5]
    assert shard.ids[rows_].tolist() == best.tolist() and scores.tolist() == (plain @ query)[best].tolist()
    assert sum(weighed) < 3000
