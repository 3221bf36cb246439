"""Cases that fall silent on a stream: what happened in them, emitted when event time has passed their last event by a gap.

The state of a case is the list of its events that are not emitted yet, with an event-time timer at the end of its silence. When the timer
fires, runs of events that the watermark has passed by the gap leave as one row; what is left sets the next timer. So rows may
come in any order up to the watermark, and state holds open runs only. Later rows are dropped by Spark, which counts them
(numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import ship

OUT = "c long, begin_us long, end_us long, events long, trace string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def runs(events: list[tuple[int, str]], gap_us: int) -> list[list[tuple[int, str]]]:
    """Events (time, activity), cut where more than gap_us lies between two."""
    out: list[list[tuple[int, str]]] = []
    for x in sorted(events):
        if out and x[0] - out[-1][-1][0] <= gap_us:
            out[-1].append(x)
        else:
            out.append([x])
    return out


class SilentRuns(StatefulProcessor):
    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("events", "us long, a string")

    def _time(self, us: int) -> int:
        """The millisecond at which the silence after an event is over."""
        return -(-(us + self.gap_us) // 1000)

    def _wait(self, held: list[list[tuple[int, str]]]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.handle.registerTimer(self._time(held[0][-1][0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(u), a) for x in rows for u, a in zip(x["us"], x["a"], strict=True)]
        old = [(int(x[0]), x[1]) for x in self.kept.get()] if self.kept.exists() else []
        self.kept.appendList(new)
        self._wait(runs(old + new, self.gap_us))
        yield pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = runs([(int(x[0]), x[1]) for x in self.kept.get()], self.gap_us) if self.kept.exists() else []
        over = [x for x in held if self._time(x[-1][0]) <= now]
        left = held[len(over) :]
        if left:
            self.kept.put([x for run in left for x in run])
        else:
            self.kept.clear()
        self._wait(left)
        yield pd.DataFrame([(key[0], x[0][0], x[-1][0], len(x), ">".join(a for _, a in x)) for x in over], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def silent_runs(events: DataFrame, gap_us: int, late: str = "10 minutes") -> DataFrame:
    """(c, begin_us, end_us, events, trace) of a stream (ts timestamp, us long, c long, a string): runs of a case, once nothing has
    happened in it for gap_us. The session's state store must be RocksDB's."""
    spark: SparkSession = events.sparkSession
    ship(spark)
    stream = events.withWatermark("ts", late).select("ts", "us", "c", "a")
    return stream.groupBy("c").transformWithStateInPandas(SilentRuns(gap_us), OUT, "Append", "EventTime")
