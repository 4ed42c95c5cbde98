"""Sessions that go stale: event-time timers tell when a key was last heard of.

A key's session is fresh until `limit` seconds after its last row. When a row comes later than that, or the watermark passes
that time, the session is reported stale, once, and its state goes; the next row starts a new session. Rows of a key may be out of
order within the watermark's delay only where they do not change which gaps exceed the limit: a row older than the last one
counts and moves nothing. Rows without key or time take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys that share a group's state: those whose number is the same but for its last bits. A call costs some milliseconds whatever it holds.
BITS = 8
GROUP = 1 << BITS
STALE = "key long, first_ts timestamp, last_ts timestamp, n long, stale_ts timestamp"


class StaleSessions(StatefulProcessor):
    """Rows (key, micros) of a group of keys, at most `GROUP`, whose running sessions are its state. One timer stands at the first end."""

    def __init__(self, limit: int):
        self.limit = limit * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "key array<bigint>, first array<bigint>, last array<bigint>, n array<bigint>")

    def close(self) -> None:
        pass

    def _held(self) -> np.ndarray:
        """key, first, last and n of each running session, by key."""
        return np.array(self.sessions.get(), np.int64) if self.sessions.exists() else np.zeros((4, 0), np.int64)

    def _hold(self, held: np.ndarray) -> None:
        if held.shape[1]:
            self.sessions.update(tuple(x.tolist() for x in held))
            self.handle.registerTimer(int(self._timer(held[2]).min()))
        else:
            self.sessions.clear()

    def _stale(self, ended: np.ndarray) -> pd.DataFrame:
        key, first, last, n = ended
        when = lambda x: pd.to_datetime(x, unit="us", utc=True)
        return pd.DataFrame({"key": key, "first_ts": when(first), "last_ts": when(last), "n": n, "stale_ts": when(last + self.limit)})

    def _timer(self, last: np.ndarray) -> np.ndarray:
        return -(-(last + self.limit) // 1000)  # whole milliseconds, not before the limit

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        keys, times = new["key"].to_numpy(np.int64), new["micros"].to_numpy(np.int64)
        order = np.lexsort((times, keys))
        keys, times = keys[order], times[order]
        # a session of this batch is a run of a key's times without a longer gap
        at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (np.diff(times) > self.limit))))
        end = np.append(at[1:], len(times))
        runs = np.stack((keys[at], times[at], times[end - 1], end - at))
        held = self._held()
        n = held.shape[1]
        if n:
            self.handle.deleteTimer(int(self._timer(held[2]).min()))
        # a run goes on with its key's session if it does not start too long after it
        own = np.searchsorted(held[0], runs[0])
        goes_on = np.append(held[0], 0)[own] == runs[0]
        goes_on &= (own < n) & (runs[1] - np.append(held[2], 0)[own] <= self.limit)
        kind = np.concatenate((np.zeros(n, np.int64), np.where(goes_on, 1, 2)))
        every = np.concatenate((held, runs), axis=1)
        order = np.lexsort((every[1], kind, every[0]))
        every, at = every[:, order], np.flatnonzero(kind[order] != 1)
        every = np.stack((every[0][at], np.minimum.reduceat(every[1], at), np.maximum.reduceat(every[2], at), np.add.reduceat(every[3], at)))
        runs_on = np.append(every[0][1:] != every[0][:-1], True)
        self._hold(every[:, runs_on])
        if not runs_on.all():
            yield self._stale(every[:, ~runs_on])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        ended = self._timer(held[2]) <= timerValues.getCurrentWatermarkInMs()
        if ended.any():
            self._hold(held[:, ~ended])
            yield self._stale(held[:, ended])


def stale_sessions(rows: DataFrame, key: str, ts: str, limit: int, delay: str = "0 seconds") -> DataFrame:
    """STALE of a stream: each session of `key` that has ended, with its number of rows and the time from which it was stale."""
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    rows = rows.withWatermark("ts", delay).withColumns({"micros": F.unix_micros("ts"), "keys": F.shiftright("key", BITS)})
    return rows.groupBy("keys").transformWithStateInPandas(StaleSessions(limit), STALE, "append", "eventTime")
