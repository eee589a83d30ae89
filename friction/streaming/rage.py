"""Streaming: rage clicks that reset when they fire."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

WINDOW_MS, CLICKS = 2000, 3


def observe(clicks: list[int], ms: int, n: int = CLICKS, window: int = WINDOW_MS) -> tuple[list[int], bool]:
    """The clicks still in the window after one more, and whether it fires; firing forgets all."""
    clicks = [c for c in clicks if ms - c <= window] + [ms]
    return ([], True) if len(clicks) >= n else (clicks, False)


def timed(events: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """A stream of events with event_time and a watermark: state of what is older than `delay` may go, and later events are
    left out. A watermark starts at 0 and drops what is not above it, so event times are one millisecond on."""
    return events.withColumn("event_time", F.timestamp_millis(F.col("ms") + 1)).withWatermark("event_time", delay)


def rage_clicks(events: DataFrame) -> DataFrame:
    """session_id, element_id, ms of each firing, on a stream of timed() events. State: the last clicks of a (session, element),
    until the watermark passes the window of the last."""

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        clicks = list(state.get[0]) if state.exists else []
        fired = []
        for ms in sorted(int(x) for pdf in frames for x in pdf["ms"]):
            clicks, fires = observe(clicks, ms)
            if fires:
                fired.append(ms)
        if clicks:
            state.update((clicks,))
            state.setTimeoutTimestamp(max(clicks[-1] + WINDOW_MS, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"session_id": [key[0]] * len(fired), "element_id": [key[1]] * len(fired), "ms": fired})

    clicks = events.where("event_type = 'CLICK'").groupBy("session_id", "element_id")
    return clicks.applyInPandasWithState(run, "session_id string, element_id string, ms long", "clicks array<long>", "append", GroupStateTimeout.EventTimeTimeout)
