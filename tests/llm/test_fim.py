"""Fill-in-middle against a plain reading of the rule, and the exception index against decoded text."""

import hashlib
import re

import numpy as np
import pytest
from conftest_llm import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fundlens.llm import fim

EXTRA = ["<P> marked", "<", "<S", "a<", "é<M>", "ñ" * 50, "a" * 100, "漢字かな 😀!", "x😀y😀z", "A1b2"]


def expected(doc_id, text, unit="token"):
    t = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t) if unit == "token" else list(t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, t
    spm = h[3] % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(tokens), "spm" if spm else "psm", len(prefix), len(middle), out


@given(st.text(alphabet="ab é漢😀<.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_index_converts_both_ways(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.ExceptionIndex(data)
    bytes_at = np.cumsum([0] + [len(c.encode()) for c in text])
    assert index.bytes(np.arange(len(text) + 1)).tolist() == bytes_at.tolist()
    assert index.chars(bytes_at).tolist() == list(range(len(text) + 1))
    assert len(index.at) == sum(ord(c) > 127 for c in text)


@pytest.mark.parametrize("unit", ["token", "char"])
def test_against_the_rule(spark, documents, odd, empty, clashing, unit):
    planted = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(EXTRA * 12)], "doc_id long, text string").repartition(2)
    for docs in (documents, odd, empty, clashing, planted):
        got = fim.transformed(docs, unit).withColumn("back", fim.restored(F.col("_output"), F.col("_form")))
        assert [c for c in docs.columns if c != "text"] == got.columns[: len(docs.columns) - 1]
        found = sorted((str(r["doc_id"]), r["_n"], r["_form"], r["_prefix_chars"], r["_middle_chars"], r["_output"]) for r in rows(got))
        assert found == sorted((str(d), *rest) for d, *rest in (expected(r["doc_id"], r["text"], unit) for r in rows(docs)))
        assert sorted(r["back"] for r in rows(got)) == sorted(r["text"] or "" for r in rows(docs))


def test_forms_and_unknown_unit(spark, documents):
    assert {r["form"] for r in rows(fim.report(documents))} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        fim.transformed(documents, "word")
