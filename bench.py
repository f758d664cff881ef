"""Times the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Matching first, then dashboards, maintenance, records and documents.
HEADLINE = (
    "match_scores", "match_threshold", "eligible_pairs", "eligibility_funnel", "score_region", "dashboard_rows", "card_dedup", "company_eligible_count",
    "dedup_calls_strict", "find_dup_hash", "normalise_calls", "validate_calls", "ingest_routing", "merge_partials", "match_upsert", "infer_deadline", "page_segments", "chunk_documents", "html_main_text", "rate_admission",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from fundlens.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    pairs = spark.read.parquet(f"{sf_dir}/part.parquet").count() * spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": re.sub(r".*sf", "", sf_dir.rstrip("/"))}
    if "match_scores" in seconds:
        line["pairs_per_second"] = round(pairs / seconds["match_scores"])
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
