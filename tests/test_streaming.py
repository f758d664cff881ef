import datetime

from pyspark.sql import functions as F

from fundlens.operators import admission
from fundlens.plans import match_queries as Q
from fundlens.sources import sinks, tables as T
from fundlens.streaming import admission as stream_admission, ingest


def brute(events, window, hits):
    kept, out = {}, {}
    for key, ts, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        live = [h for h in kept.get(key, []) if (ts - h).total_seconds() <= window]
        out[i] = len(live) < hits
        kept[key] = live + ([ts] if out[i] else [])
    return out


def events(n=600):
    import random

    rng = random.Random(5)
    base = datetime.datetime(2024, 1, 1)
    # One key holds most of the events.
    return [(0 if rng.random() < 0.6 else rng.randint(1, 5), base + datetime.timedelta(seconds=rng.randint(0, 200_000)), i) for i in range(n)]


def test_batch_admission(spark):
    rows = events()
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp, event_id bigint")
    got = {r.event_id: r.admitted for r in admission.admit(df, "user_id", "ts", "event_id", 3600, 4).collect()}
    assert got == brute(rows, 3600, 4)
    assert 0 < sum(got.values()) < len(rows)


def test_stream_admission_agrees_with_batch(spark, tmp_path):
    rows = sorted(events(200), key=lambda e: e[1])
    for n in range(4):  # four files in time order
        spark.createDataFrame(rows[n * 50:(n + 1) * 50], "user_id bigint, ts timestamp, event_id bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint, ts timestamp, event_id bigint").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    judged = stream_admission.admit_stream(stream, "user_id", "ts", "event_id", "1 day", 3600, 4)
    q = judged.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.event_id: r.admitted for r in spark.table("admitted").collect()}
    assert got == brute(rows, 3600, 4)


def test_ingest_stream(spark, sf, tmp_path):
    docs = T.documents(spark, sf).select(F.col("doc_id").alias("call_id"), "text")
    rows = T.raw_calls(spark, sf).join(docs, "call_id").withColumn("arrived", F.lit("2024-06-01 10:00:00").cast("timestamp"))
    rows.select("call_id", "payload", "text", "arrived").repartition(2).write.parquet(str(tmp_path / "in"))
    source = ingest.read_submissions(spark, str(tmp_path / "in"), 1)
    day = datetime.date(2024, 6, 1)
    q = ingest.ingest(source, T.companies(spark, sf), str(tmp_path / "out"), str(tmp_path / "ck"), day).trigger(availableNow=True).start()
    q.awaitTermination(600)
    records = spark.read.parquet(str(tmp_path / "out" / "records"))
    assert records.count() > 0
    assert records.groupBy("document_hash").count().filter("count > 1").isEmpty()
    valid = ingest.publishable(records).filter("review_status = 'validato'").select("call_id")
    matches = spark.read.parquet(str(tmp_path / "out" / "matches"))
    assert matches.count() == valid.count() * T.companies(spark, sf).count()
    assert matches.join(valid, "call_id", "left_anti").isEmpty()


def test_late_and_repeated_submissions(spark, sf, tmp_path):
    """A text a month late is stored; a copy that comes a month after is not stored again; a known title is marked."""
    import json

    body = lambda title: json.dumps({"bando": {"titolo": title, "ente": "Ente"}})
    day = lambda n: datetime.datetime(2024, 6, 1) + datetime.timedelta(days=n)
    arrivals = [(1, body("Uno"), "testo uno", day(0)), (2, body("Due"), "testo due", day(60)), (3, body("Tre"), "testo tre", day(29)), (4, body("Uno"), " TESTO  uno", day(61)), (5, body("due"), "altro testo", day(62))]
    source = tmp_path / "in"
    source.mkdir()
    q = ingest.ingest(ingest.read_submissions(spark, str(source), 1), T.companies(spark, sf).limit(5), str(tmp_path / "out"), str(tmp_path / "ck"), datetime.date(2024, 6, 1))
    for row in arrivals:
        spark.createDataFrame([row], ingest.SUBMISSION).coalesce(1).write.mode("append").parquet(str(source))
        run = q.trigger(availableNow=True).start()
        run.awaitTermination(300)
    got = {r.call_id: r.duplicate_of for r in spark.read.parquet(str(tmp_path / "out" / "records")).collect()}
    assert got == {1: None, 2: None, 3: None, 5: 2}


def test_sinks(spark, sf, tmp_path):
    from fundlens.plans import dashboard_queries as D, report_queries as R
    from fundlens.sources import readers

    sinks.write_csv(D.match_export(spark, sf).drop("match_id"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["cliente", "bando", "score_totale", "score_regione", "score_ateco", "score_dimensione", "score_fatturato"]
    sinks.write_sheets(R.sheet_markdown(spark, sf), str(tmp_path / "sheets"))
    assert spark.read.parquet(str(tmp_path / "sheets")).count() == T.calls(spark, sf).count()
    sinks.write_calls(Q.funds(spark, sf).select("call_id", "title", "review_status"), str(tmp_path / "calls"))
    assert {p.name for p in (tmp_path / "calls").iterdir() if p.is_dir()} == {"review_status=validato", "review_status=da_revisionare"}
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "up" / "b.txt").write_bytes(b"text")
    files = readers.read_binary(spark, str(tmp_path / "up"))
    assert {r[0] for r in files.select(readers.byte_gate(F.col("content"))).collect()} == {"ok", "not_pdf"}
