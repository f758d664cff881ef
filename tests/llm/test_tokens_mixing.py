"""Token files and source mixing against plain Python."""

import math
import re
import struct
import zlib
from collections import defaultdict

import pytest
from conftest_llm import rows

from fundlens.llm import kit, mixing, tokens
from fundlens.llm.catalog import tokenizer_path


def expected_index(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for r in sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode())):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_token_files_hold_what_the_tokenizer_gives(spark, request, tmp_path, name):
    docs = request.getfixturevalue(name)
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs, path, tokenizer_path())
    got = tokens.token_index(tokens.read_tokens(spark, path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_index(rows(docs))


def test_token_files_are_sorted_and_indexed(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "tokens"
    tokens.write_tokens(documents, str(path), tokenizer_path(), row_group_bytes=64 << 10)
    ends = []
    for f in sorted(path.glob("part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            col = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            assert col["doc_id"].has_column_index and col["doc_id"].has_offset_index
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(col["ids.list.element"].encodings)
            ends += [col["doc_id"].statistics.min, col["doc_id"].statistics.max]
    assert ends == sorted(ends)
    plan = tokens.read_tokens(spark, str(path)).where("doc_id between 10 and 20").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in plan and "ids:array" not in plan.split("ReadSchema")[1]


# -- mixing ---------------------------------------------------------------------------------------------------


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
            left -= target[s] if over else 0
        if not over:
            break
        free -= over
    return target


def check_mix(got, docs):
    sizes, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs:
        n = words(r["text"])
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    target = expected_targets(sizes)
    source = {r["doc_id"]: r["source"] for r in docs}
    size = {r["doc_id"]: words(r["text"]) for r in docs}
    assert len(got) == len(docs)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9)
        whole = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        assert r["taken"] in (whole * r["size"], (whole + 1) * r["size"]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s], (s, taken[s], target[s])


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_mix_meets_targets(request, name):
    docs = request.getfixturevalue(name).cache()
    got = rows(mixing.mix_plan(docs))
    check_mix(got, rows(docs))
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix_plan(docs.repartition(5)))))


def test_mixed_rows_follow_the_plan(documents, clashing):
    for docs in (documents, clashing):
        plan = {r["doc_id"]: r["copies"] for r in rows(mixing.mix_plan(docs))}
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        count = defaultdict(int)
        for r in rows(out):
            count[r["doc_id"]] += 1
        assert {k: v for k, v in plan.items() if v} == dict(count)


def test_weights_favour_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i in range(2000) for s in ("a", "b")][:4000], "doc_id long, text string, source string").selectExpr("doc_id * 2 + int(source = 'b') doc_id", "text", "source")
    good = docs.where("doc_id % 4 < 2").selectExpr("doc_id", "5.0 weight")
    taken = mixing.mix_plan(docs, good).where("target < source_size").groupBy((mixing.F.col("doc_id") % 4 < 2).alias("good")).agg(mixing.F.avg("copies").alias("share"))
    share = {r["good"]: r["share"] for r in taken.collect()}
    assert share[True] > share[False] + 0.2


def test_targets_with_full_sources(spark):
    sizes = {"a": 1000, "b": 1, "c": 0, "d": 50, None: 3, "e": 2}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: round(r["target"], 6) for r in got} == {k: round(v, 6) for k, v in expected_targets(sizes).items()}


def test_word_hashes_do_not_depend_on_place():
    import numpy as np

    data = np.frombuffer(b"alpha beta alpha" + b" beta" * 10, np.uint8)
    hashes, bounds = kit.hashed_words(data, np.array([0, 16, len(data)]), kit.NOT_BLANK)
    assert bounds.tolist() == [0, 3, 13] and hashes[0] == hashes[2] and len(set(hashes[[1, *range(3, 13)]].tolist())) == 1


def test_empty_documents_of_a_source_taken_in_full(spark):
    """A source that is taken three times gives its empty documents three times, not four."""
    docs = spark.createDataFrame([(i, "" if i % 2 else "one two", "small") for i in range(10)] + [(100 + i, "word " * 50, "tall") for i in range(10)], "doc_id long, text string, source string")
    plan = {r["doc_id"]: (r["copies"], r["source_size"], r["target"]) for r in rows(mixing.mix_plan(docs))}
    assert all(plan[i][2] == 3 * plan[i][1] for i in range(10)) and {plan[i][0] for i in range(10)} == {3}
    assert mixing.mixed(docs).where("source = 'small'").count() == 30
