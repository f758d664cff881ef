"""The pipeline: every stage on all that its predecessor kept."""

import corpus_pipeline
from conftest_llm import rows
from test_shingles import shingle_set

from fundlens.llm import catalog, decontaminate


def test_stages_follow_each_other(spark):
    sf = "/root/testdata/sf0.01"
    docs = catalog.table(spark, sf, "documents")
    columns = docs.columns
    seen = [{r["doc_id"] for r in rows(docs)}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        seen.append({r["doc_id"] for r in rows(docs)})
        assert seen[-1] <= seen[-2]
        if name == "near_dedup":
            kept = [shingle_set(r["text"]) for r in rows(docs)]
            assert len(kept) == len(seen[-1]) and not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)))
        if name == "decontamination":
            assert not any(r["contaminated"] for r in rows(decontaminate.report(docs, catalog.table(spark, sf, "benchmark"))))
    assert len(seen[0]) > len(seen[1]) > len(seen[2]) > len(seen[3]) >= len(seen[4]) > 500
    index = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert index.count() == docs.count()


def test_registered_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]


def test_whole_pipeline_on_odd_tables(spark, tmp_path, odd, empty, clashing):
    """Nulls in all columns, no rows, and other columns with names that operators use: every stage keeps the columns, the last gives a row a kept row."""
    small = "/root/testdata/sf0.001"
    for name, docs in (("odd", odd), ("empty", empty), ("clashing", clashing)):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        for table in ("labels", "benchmark"):
            some = catalog.table(spark, small, table)
            (some.where("false") if name == "empty" else some).write.parquet(f"{sf}/{table}.parquet")
        kept = catalog.table(spark, sf, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == docs.columns
        got = rows(corpus_pipeline.run(spark, sf))
        assert len(got) == kept.count() and {str(r["doc_id"]) for r in got} <= {str(r["doc_id"]) for r in rows(docs)}
        assert name == "empty" or got
