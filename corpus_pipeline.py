"""From raw documents to token files: the stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundlens.llm import catalog, decontaminate, kit, mixing, quality, shingles, tokens


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labelled ones rejects go."""
    return quality.filtered(docs, catalog.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word similarity of 0.8 or more joins stays, that of the smallest doc_id."""
    return shingles.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.clean(docs, catalog.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix of sources takes them: repeated, once or not at all."""
    return mixing.mixed(docs, catalog.qualities(catalog.table(spark, sf_dir, "labels")))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files written from all rows."""
    path = kit.scratch_path(spark, "tokens")
    tokens.write_tokens(docs, path, catalog.tokenizer_path())
    return tokens.token_index(tokens.read_tokens(spark, path))


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", source_mix), ("token_output", token_files)]
#: Classifiers, SimHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read by the next.

    Null and empty texts are documents like any (they have no words and one token each), repeated rows are near copies of
    each other, ties fall to the smallest id, texts of any length go whole, other columns are carried along whatever
    their names, and an empty table gives no rows.
    """
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kit.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
