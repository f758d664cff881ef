"""The admission rule on a stream: the admitted hits of each key are its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import refdata as R


def admit_stream(events: DataFrame, key: str, ts: str, event_id: str, delay: str = "10 minutes",
                 window: int = R.ADMISSION_WINDOW_SECONDS, max_hits: int = R.ADMISSION_MAX_HITS) -> DataFrame:
    """Streaming events with ``admitted``. A key whose window has passed is dropped from the state."""
    micros = window * 1_000_000

    def judge(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(batches)).sort_values(["_us", event_id])
        verdicts = []
        for now in frame["_us"]:
            hits = [h for h in hits if now - h <= micros]
            verdicts.append(len(hits) < max_hits)
            if verdicts[-1]:
                hits.append(int(now))
        state.update((hits,))
        state.setTimeoutTimestamp(max(int(frame["_us"].max()) // 1000 + window * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield frame[[key, event_id, ts]].assign(admitted=verdicts)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    timed = events.withWatermark(ts, delay).select(key, event_id, ts, F.unix_micros(ts).alias("_us"))
    return timed.groupBy(key).applyInPandasWithState(
        judge, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, {ts} {kinds[ts]}, admitted boolean",
        "hits array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
