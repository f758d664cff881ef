"""Greedy admission per key: at most N admitted hits in any trailing window; refused hits do not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import refdata as R


def micros(ts: Column, zoned: bool) -> Column:
    """Microseconds since the epoch; a time without a zone is read as it stands, whatever the session's zone."""
    if zoned:
        return F.unix_micros(ts)
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def admit(events: DataFrame, key: str, ts: str, event_id: str, window: int = R.ADMISSION_WINDOW_SECONDS,
          max_hits: int = R.ADMISSION_MAX_HITS) -> DataFrame:
    """Events with ``admitted``.

    Time is cut into buckets as long as the window. An empty bucket forgets everything before it, so a
    key falls into runs of busy buckets that are judged apart. Rows stream through their task in time
    order and only the last N admitted hits are kept, whatever the length of a run.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    us = micros(F.col(ts), kinds[ts] == "timestamp")
    timed = events.select(F.col(key), F.col(event_id), F.col(ts), us.alias("_us"), F.floor(us / (window * 1_000_000)).cast("bigint").alias("_bucket"))
    busy = timed.select(key, "_bucket").distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("_bucket"))
    runs = busy.withColumn("_run", F.col("_bucket") - place)
    ordered = (
        timed.join(runs, [key, "_bucket"])
        .repartition(key, "_run")
        .sortWithinPartitions(key, "_run", "_us", event_id)
        .select(key, "_run", "_us", event_id, ts)
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hits = None, deque(maxlen=max_hits)
        for batch in batches:
            verdicts = []
            for k, run, now in zip(batch[key], batch["_run"], batch["_us"]):
                if (k, run) != current:
                    current = (k, run)
                    hits.clear()
                while hits and now - hits[0] > window * 1_000_000:
                    hits.popleft()
                verdicts.append(len(hits) < max_hits)
                if verdicts[-1]:
                    hits.append(now)
            yield batch[[key, event_id, ts]].assign(admitted=verdicts)

    return ordered.mapInPandas(judge, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, {ts} {kinds[ts]}, admitted boolean")
