"""Log statistics kept up to date by Structured Streaming. Event time is a timestamp with time zone (watermarks need one)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship


def events_per_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(from, a, n) of a stream (ts timestamp, a): activity counts by tumbling hour, late rows up to the watermark."""
    hours = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "a").agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.col("window.start").alias("from"), "a", "n")


def circadian(events: DataFrame) -> DataFrame:
    """(w, h, n): the histogram of weekdays (Monday = 0) and hours."""
    return events.groupBy(F.weekday("ts").alias("w"), F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))


def follows(events: DataFrame, keep: str = "7 days") -> DataFrame:
    """(c, a, b): each event of a stream (ts timestamp, c long, a string) with the next of its case, in arrival order.

    The state of a case is its last activity; it is dropped when event time has passed it by `keep`.
    """
    ship(events.sparkSession)
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        all_rows = pd.concat(list(rows)).sort_values("ts", kind="stable")
        names = all_rows["a"].tolist()
        before = ([last] if last is not None else []) + names
        pairs = list(zip(before, before[1:], strict=False))
        state.update((names[-1],))
        state.setTimeoutTimestamp(max(int(all_rows["ts"].max().timestamp() * 1000) + ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"c": [key[0]] * len(pairs), "a": [x for x, _ in pairs], "b": [y for _, y in pairs]})

    stream = events.withWatermark("ts", "1 hour").select("ts", "c", "a")
    return stream.groupBy("c").applyInPandasWithState(step, "c long, a string, b string", "last string", "append", GroupStateTimeout.EventTimeTimeout)
