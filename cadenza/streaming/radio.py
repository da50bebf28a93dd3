"""Radio sessions as a stream: state by user that expires, folded event by event.

The state holds the base, the sum of feedback so far, what was heard last and the dial;
one event ages the sum and adds to it, so that no log is kept. A session ends by a timer
four hours after its last event, or by an event that comes later than that; it is then
emitted as it stood. The rows are those of operators.radio.fold, where events of a user come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import unit
from ..operators import radio

ENDED = "user_id string, session_no long, last_active long, feedback long, heard array<string>, v array<double>"
_STATE = "session_no long, last_active long, feedback long, heard array<string>, base array<double>, moved array<double>, dial double"


class Sessions(StatefulProcessor):
    """One value a user: (number, last event, feedback, heard, base, sum of feedback, dial)."""

    def __init__(self, ttl_s: int = radio.TTL_S) -> None:
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)

    def _held(self) -> list | None:
        return list(self.state.get()) if self.state.exists() else None

    def _ended(self, user: str, s: list) -> pd.DataFrame:
        number, last, n, heard, base, moved, dial = s
        v = None
        if base is not None:
            v = np.array(base)
            if moved is not None:
                sum_ = v + np.array(moved) * radio.SHARE * max(0.0, 1.0 + (dial - radio.BALANCED))
                v = sum_ / np.linalg.norm(sum_) if (np.abs(sum_) > 1e-9).any() else v
            v = v.tolist()
        return pd.DataFrame({"user_id": [user], "session_no": [number], "last_active": [last], "feedback": [n], "heard": [list(heard)], "v": [v]})

    def _step(self, s: list, row: tuple) -> None:
        """One event: row is (ts, event_type, track_id, v, dial)."""
        ts, kind, track, v, dial = row
        s[1], s[6] = ts, dial
        if kind == "play_start":
            s[3] = [*s[3], track][-radio.HEARD :]
            if s[4] is None and v is not None:
                s[4] = list(v)
        else:
            s[2] += 1
            moved = None if s[5] is None else np.array(s[5]) * radio.DECAY
            if v is not None:
                pull = np.array(v) * radio.WEIGHTS[kind]
                moved = pull if moved is None else moved + pull
            s[5] = None if moved is None else moved.tolist()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, done = self._held(), 0 if not self.state.exists() else self.state.get()[0]
        before = s[1] if s else None
        for part in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples(index=False):
            if s is not None and part.ts - s[1] > self.ttl_s:
                yield self._ended(key[0], s)
                done, s = s[0], None
            if s is None:
                s = [done + 1, part.ts, 0, [], None, None, radio.BALANCED]
            self._step(s, (int(part.ts), part.event_type, part.track_id, part.v, float(part.dial)))
        if s is not None:
            self.state.update(tuple(s))
            if before is not None:
                self.handle.deleteTimer((before + self.ttl_s) * 1000)
            self.handle.registerTimer((s[1] + self.ttl_s) * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._held()
        if s is not None:
            self.state.clear()
            yield self._ended(key[0], s)

    def close(self) -> None:
        pass


def ended(stream: DataFrame, library: DataFrame, ttl_s: int = radio.TTL_S) -> DataFrame:
    """The sessions of a stream of events (user_id, id, ts, time, event_type, track_id, dial) that have ended; numbers begin anew after a pause that let a timer expire."""
    vectors = library.select("track_id", unit(F.col("v")).alias("v"))
    own = stream.filter(F.col("event_type").isin(*radio.KINDS)).select("user_id", "id", "ts", "time", "event_type", "track_id", "dial").join(vectors, "track_id", "left")
    return own.groupBy("user_id").transformWithStateInPandas(Sessions(ttl_s), ENDED, "append", "eventTime")


def needed_conf() -> dict[str, str]:
    """Settings of a session that runs this stream."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
