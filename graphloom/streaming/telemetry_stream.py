"""Telemetry as a stream: windowed metrics with late data bounded, and the state machine of requests by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import MAX_EVENTS

EVENT_SCHEMA = "event_id long, ts timestamp, request_id string, event_type string, value double"


def windowed_metrics(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and the largest value of each window and type; events later than `late` no longer count."""
    at = F.window("ts", length, slide)
    out = events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "max_value")


def judged(events: DataFrame, started: str, ended: tuple[str, ...], keep: str = "30 days", most: int = MAX_EVENTS) -> DataFrame:
    """event_id, request_id, verdict as request_states gives them, with state by request that goes `keep` after its last event.

    A request's events are judged in the order of event_id within a batch; its state is four numbers.
    """
    days = int(pd.Timedelta(keep) / pd.Timedelta(milliseconds=1))

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, over, n = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        start, end = (rows.event_type == started).to_numpy(), rows.event_type.isin(ended).to_numpy()
        before = lambda marks, first: first + np.cumsum(marks) - marks  # what stood before each row
        starts = before(start.astype(np.int64), opened)
        counted = (starts > 0) | start
        overs, places = before((end & counted).astype(np.int64), over), before(counted.astype(np.int64), n)
        verdict = np.select([~counted, overs > 0, start & (starts > 0), places >= most], ["before_start", "after_end", "started_twice", "too_many"], "accepted")
        opened, over, n = opened + start.sum(), over + (end & counted).sum(), n + counted.sum()
        state.update((int(opened), int(over), int(n)))
        state.setTimeoutTimestamp(int(rows.ts.max().timestamp() * 1000) + days)
        yield pd.DataFrame({"event_id": rows.event_id, "request_id": key[0], "verdict": verdict})

    marked = events.withWatermark("ts", "2 hours").select("event_id", "ts", "request_id", "event_type")
    return marked.groupBy("request_id").applyInPandasWithState(judge, "event_id long, request_id string, verdict string", "opened long, over long, n long", "append", GroupStateTimeout.EventTimeTimeout)
