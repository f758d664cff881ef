"""Incremental ingest: submissions arrive as files, copies are dropped, the rest is validated and matched."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as X
from ..operators import evidence as E, matching as M, normalise as O, profiles as P, validate as V
from ..functions import refdata as R
from .keystore import KeyStore

SUBMISSION = "call_id bigint, payload string, text string, arrived timestamp"


def read_submissions(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_submissions(submissions: DataFrame) -> DataFrame:
    """Submissions that are calls, with the hash of their text. Stateless: however late one arrives, none is dropped."""
    hashed = submissions.withColumn("document_hash", X.content_hash(F.col("text")))
    return hashed.filter(E.relevance(F.lit(None).cast("string"), F.col("text")).isNull() & F.col("document_hash").isNotNull())


def unseen(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Of a batch, the smallest call_id of each text that no earlier batch has stored. known: document_hash of those."""
    row = F.struct(*batch.columns)
    once = batch.groupBy("document_hash").agg(F.min_by(row, "call_id").alias("row")).select("row.*")
    return once if known is None else once.join(known.select("document_hash").distinct(), "document_hash", "left_anti")


def earlier_records(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """Records stored by batches before this one; a batch that runs again does not see its own."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/records")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(f"{out}/records").filter(F.col("batch") < batch_id)


def title_key() -> Column:
    """Title and issuer of a record as one key; null where there is no title."""
    named = [F.lower(F.coalesce(c, F.lit(""))) for c in ("titolo", "ente")]
    return F.when(F.trim(named[0]) != "", F.sha2(F.concat_ws("\u001f", *named), 256))


def title_duplicates(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records with `duplicate_of`: the oldest earlier record of the same title and issuer, if any. known: key, call_id."""
    keyed = records.withColumn("_key", title_key())
    older = known.select(F.col("key").alias("_key"), F.col("call_id").alias("duplicate_of"))
    untitled = keyed.where("_key is null").withColumn("duplicate_of", F.lit(None).cast("bigint"))
    return keyed.where("_key is not null").join(older, "_key", "left").select(*records.columns, "duplicate_of").unionByName(untitled.select(*records.columns, "duplicate_of"))


def key_stores(spark: SparkSession, out: str, batch_id: int) -> tuple[KeyStore, KeyStore]:
    """The stores of document hashes and of titles; records of a time before the stores are taken in once."""
    stores = KeyStore(spark, f"{out}/keys/documents"), KeyStore(spark, f"{out}/keys/titles")
    if batch_id and not stores[0].segments() and (known := earlier_records(spark, out, batch_id)) is not None:
        stores[1].add(known.select(title_key().alias("key"), "call_id"), batch_id - 1, first=0)
        stores[0].add(known.select(F.col("document_hash").alias("key"), "call_id"), batch_id - 1, first=0)
    return stores


def validated_records(batch: DataFrame, as_of: datetime.date) -> DataFrame:
    """Validated records of a batch with their review status; erroneous ones keep their errors."""
    record = O.normalise(batch.select("call_id", "payload", "text", "document_hash"))
    checked = V.validate(record, "text", as_of)
    return checked.withColumns(
        {
            "late_reason": E.relevance(F.col("titolo"), F.col("text")),
            "review_status": F.when(F.col("needs_review"), R.PENDING).otherwise(R.VALIDATED),
        }
    ).drop("payload", "text")


def publishable(records: DataFrame) -> DataFrame:
    return records.filter((F.size("errors") == 0) & F.col("late_reason").isNull() & F.col("duplicate_of").isNull())


def scores(records: DataFrame, companies: DataFrame, as_of: datetime.date) -> DataFrame:
    """Scores of the stored records that need no review."""
    valid = publishable(records).filter(F.col("review_status") == R.VALIDATED)
    ready = P.prepare_calls(O.to_calls(valid))
    return M.score_pairs(ready, P.prepare_companies(companies, as_of)).select("call_id", "company_id", "score")


def ingest(submissions: DataFrame, companies: DataFrame, out: str, checkpoint: str, as_of: datetime.date) -> DataStreamWriter:
    """Writer that stores records and scores per batch. A batch that runs again replaces its own output.

    A text that any earlier batch has stored is not stored again, whenever it comes; a record whose title and issuer are
    known is stored with the older one's id and not matched.

    What is stored is asked by key: a batch reads the parts of the key stores that its own hashes and titles fall in, never
    the records. The records are read back before they are matched, so validation runs once per record and the
    matching plan starts from a table.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"{out}/records/batch={batch_id}"
        documents, titles = key_stores(spark, out, batch_id)
        seen = documents.find(batch.select(F.col("document_hash").alias("key")), batch_id)
        validated_records(unseen(batch, seen.select(F.col("key").alias("document_hash"))), as_of).write.mode("overwrite").parquet(f"{out}/staged")
        staged = spark.read.parquet(f"{out}/staged")
        title_duplicates(staged, titles.find(staged.select(title_key().alias("key")), batch_id)).write.mode("overwrite").parquet(place)
        stored = spark.read.parquet(place)
        scores(stored, companies, as_of).write.mode("overwrite").parquet(f"{out}/matches/batch={batch_id}")
        for keys, key in ((titles, title_key()), (documents, F.col("document_hash"))):
            keys.add(stored.select(key.alias("key"), "call_id"), batch_id)
            keys.tidy(batch_id)

    return new_submissions(submissions).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
