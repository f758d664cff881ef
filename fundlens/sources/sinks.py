"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_sheets(sheets: DataFrame, path: str, buckets: int = 256) -> None:
    """Markdown sheets, one row each, in folders of call ids so that a reader finds one without a full scan."""
    bucket = F.pmod(F.xxhash64("call_id"), F.lit(buckets)).cast("int")
    sheets.select("call_id", "sheet", bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("overwrite").partitionBy("review_status").parquet(path)
