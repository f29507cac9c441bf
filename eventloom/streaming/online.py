"""Features of a running log: what a prefix allows, with a state for each case. An extension for streams.

Targets look ahead and have no online form. Ordering windows don't run on streams, so that each case keeps a small state
instead: number of events, first and last time, and the last n activities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, first double, last double, recent array<string>"
PAD = "<pad>"


def online_features(events: DataFrame, n: int = 3, forget_after: str | None = None) -> DataFrame:
    """For each event of a stream (case_id, timestamp, event_id, activity): trace_position, accumulated_time,
    time_since_last_event in seconds and activity_w_0 ... activity_w_(n-1).

    Events of a case are taken in order of time within a micro-batch; one that is older than its case's last event
    counts as it comes, with a time since it of 0 at least. forget_after: a case without events so long, in processing
    time, loses its state, like "30 days"; such a query goes on starting micro-batches without new events, to see who is
    late, so that processAllAvailable doesn't return. By default states stay.
    """
    kind = events.schema["case_id"].dataType.simpleString()
    windows = [f"activity_w_{j}" for j in range(n)]
    out = f"case_id {kind}, timestamp timestamp, event_id long, trace_position long, accumulated_time double, time_since_last_event double, " + ", ".join(f"{w} string" for w in windows)
    wait = None if forget_after is None else int(pd.Timedelta(forget_after).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, first, last, recent = state.get if state.exists else (0, None, None, [])
        recent = list(recent)
        batch = pd.concat(list(batches)).sort_values(["timestamp", "event_id"], kind="stable")
        rows = []
        for row in batch.itertuples(index=False):
            now = row.timestamp.timestamp()
            first = now if first is None else min(first, now)
            since = 0.0 if last is None else max(0.0, now - last)
            last = now if last is None else max(last, now)
            recent = [row.activity, *recent][:n]
            rows.append((key[0], row.timestamp, row.event_id, count, now - first, since, *recent, *[PAD] * (n - len(recent))))
            count += 1
        state.update((count, first, last, recent))
        if wait is not None:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["case_id", "timestamp", "event_id", "trace_position", "accumulated_time", "time_since_last_event", *windows])

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.select("case_id", "timestamp", "event_id", "activity").groupBy("case_id").applyInPandasWithState(step, out, STATE, "append", timeout)


def online_work_in_progress(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """bin_start and wip, about how many cases had events in each bin of a stream, once no more can come for it."""
    binned = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("bin"))
    return binned.agg(F.approx_count_distinct("case_id", 0.02).alias("wip")).select(F.col("bin.start").alias("bin_start"), "wip")


def online_transitions(events: DataFrame) -> DataFrame:
    """How often each activity occurs so far, as a running aggregate."""
    return events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
