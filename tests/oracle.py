"""Runs a named query on Spark and its check SQL on DuckDB and compares the rows.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(type_name: str) -> str:
    name = type_name.lower()
    if name in ("bigint", "long"):
        return "bigint"
    if name in ("integer", "int"):
        return "int"
    if name in ("varchar", "string"):
        return "string"
    return name


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    from fundlens.plans.catalog import CHECK_SQL, QUERIES

    began = time.time()
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    table = df.select(*columns).toArrow()
    spark_time = time.time() - began
    ours = Counter(zip(*[[plain(v) for v in table.column(c).to_pylist()] for c in columns])) if table.num_rows else Counter()
    if name not in CHECK_SQL:
        return table.num_rows > 0, f"rows only: {table.num_rows} rows, {spark_time:.1f}s"
    began = time.time()
    result = con.execute(CHECK_SQL[name])
    names = [d[0] for d in result.description]
    types = {d[0]: kind(str(d[1])) for d in result.description}
    fetched = result.fetchall()
    sql_time = time.time() - began
    if sorted(names) != columns:
        return False, f"columns differ: {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in fetched)
    note = f"{table.num_rows} rows, spark {spark_time:.1f}s, sql {sql_time:.1f}s"
    ours_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    off = {c: (ours_types[c], types[c]) for c in columns if ours_types[c] != types[c]}
    if ours == theirs:
        return not off, note + (f" TYPES {off}" if off else "")
    left, right = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return False, f"{note}\n   {columns}\n   only spark: {left}\n   only sql:   {right}"


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.maxResultSize", "0")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf_dir = args[at + 1]
        del args[at:at + 2]
    from fundlens.plans.catalog import QUERIES

    spark, con = session(), connect(sf_dir)
    failed = 0
    for name in args or list(QUERIES):
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
