"""Duplicates in a stream: an event is dropped within window_s of the last accepted one of its user, track and type.

State is that last accepted time, dropped by a timer once no event behind the watermark
could touch it. Where events of a key come in order, what is accepted is what
operators.ingest.accepted_times takes from the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import DUPLICATE_S, KEYS
from .events import EVENT


class LastAccepted(StatefulProcessor):
    def __init__(self, window_s: int = DUPLICATE_S) -> None:
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(["ts", "id"])
        before = last = self.last.get()[0] if self.last.exists() else None
        ts, at, kept = own["ts"].to_numpy(), 0, []
        while at < len(ts):
            if last is None or abs(int(ts[at]) - last) > self.window_s:
                kept.append(at)
                last = int(ts[at])
                at += 1
            else:
                at = max(at + 1, int(ts.searchsorted(last + self.window_s, "right")))
        if kept:
            if before is not None:
                self.handle.deleteTimer((before + self.window_s + 1) * 1000)
            self.last.update((last,))
            self.handle.registerTimer((last + self.window_s + 1) * 1000)
            yield own.iloc[kept][["id", "user_id", "track_id", "event_type", "value", "ts"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def accepted(stream: DataFrame, window_s: int = DUPLICATE_S) -> DataFrame:
    """The events of a stream (events.read) that are no duplicates."""
    return stream.groupBy(*KEYS).transformWithStateInPandas(LastAccepted(window_s), EVENT, "append", "eventTime")
