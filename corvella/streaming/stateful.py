"""Operators on streams that keep state by key and act on event time: rate limits and lost heartbeats.

Rows wait in the key's state until the watermark has passed them, so late and unordered rows are
taken in the order of their times and the result is that of the batch form. Timers wake a key
when its next row or deadline is due. A key's state is the rows of the watermark's delay and
of its own window, whatever the length of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that these operators need, for streams started within; the session's own setting comes back."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)


#: A row as the state holds it; `unnamed` is 1 where event_id is null, which comes last among equal times.
COLUMNS = ["at", "unnamed", "event_id"]


class InOrder(StatefulProcessor):
    """Rows (key, at in microseconds, event_id) handed to step() in their order once they are settled.

    A key's state is one value, packed, so that a key costs one read and one write however many
    rows it has: when it is next to be woken, the rows that wait, and what step() keeps.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "timer long, waiting binary, kept binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [b[COLUMNS].to_numpy(np.int64) for b in rows]
        yield from self._advance(key, timerValues, fresh, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, [], expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, timerValues, fresh: list[np.ndarray], fired: int | None) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        timer, waiting, kept = self.state.get() or (None, b"", b"")
        rows = np.concatenate([np.frombuffer(waiting, np.int64).reshape(-1, len(COLUMNS)), *fresh])
        rows = rows[np.lexsort(rows.T[::-1])]
        # A timer fires once the watermark is beyond it; so rows are settled by the same rule.
        n = int(np.searchsorted(wakes(rows[:, 0]), mark))
        out, kept, deadline = self.step(key, rows[:n], np.frombuffer(kept, np.int64), mark)
        left = rows[n:]
        times = ([int(wakes(left[0, 0]))] if len(left) else []) + ([deadline] if deadline is not None else [])
        due = max(min(times), mark + 1 if mark > 0 else 0) if times else None
        if due != timer or due == fired:
            # Spark itself deletes the timer that has fired.
            if timer not in (None, fired):
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None and not len(kept):
            self.state.clear()
        else:
            self.state.update((due, left.tobytes(), kept.tobytes()))
        if out is not None:
            yield out

    def step(self, key, settled: np.ndarray, kept: np.ndarray, mark: int) -> tuple[pd.DataFrame | None, np.ndarray, int | None]:
        """The rows to give for settled rows of COLUMNS, what to keep, and when to be woken without any, in milliseconds."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def ids(rows: np.ndarray) -> pd.Series:
    """event_id of rows of COLUMNS."""
    return pd.Series(rows[:, 2], dtype="Int64").mask(rows[:, 1] == 1)


def wakes(at):
    """The millisecond at which a time in microseconds has been reached, or those of an array."""
    return -(-at // 1000)


class RateLimit(InOrder):
    """How many rows of the key the window up to each row holds."""

    def __init__(self, seconds: int, limit: int):
        self.window, self.limit = seconds * 1_000_000, limit

    def step(self, key, settled, kept, mark):
        if not len(settled):
            return None, kept, None
        at = settled[:, 0]
        every = np.concatenate([kept, at])
        n = np.searchsorted(every, at, "right") - np.searchsorted(every, at - self.window)
        out = pd.DataFrame({"event_id": ids(settled), "user_id": key[0], "in_window": n, "allowed": n <= self.limit})
        return out, every[np.searchsorted(every, every[-1] - self.window) :], None


class Heartbeat(InOrder):
    """A row for each silence of the key as long as the timeout: its last sign, and when it was given up."""

    def __init__(self, timeout: int):
        self.timeout = timeout * 1_000_000

    def step(self, key, settled, kept, mark):
        signs = np.concatenate([kept.reshape(-1, len(COLUMNS)), settled])
        if not len(signs):
            return None, kept, None
        silent = np.append(np.diff(signs[:, 0]) >= self.timeout, False)
        deadline = int(wakes(signs[-1, 0] + self.timeout))
        silent[-1] = deadline < mark
        lost = signs[silent]
        out = pd.DataFrame({"user_id": key[0], "event_id": ids(lost), "last_us": lost[:, 0], "lost_us": lost[:, 0] + self.timeout}) if len(lost) else None
        return (out, signs[:0], None) if silent[-1] else (out, signs[-1:], deadline)


def _by_user(events: DataFrame, late: str) -> DataFrame:
    # Rows without a time never settle.
    rows = events.filter("ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").isNull().cast("long").alias("unnamed"), F.coalesce("event_id", F.lit(0)).alias("event_id"))
    return rows.groupBy("user_id")


def limited(events: DataFrame, seconds: int = 60, limit: int = 2, late: str = "2 hours") -> DataFrame:
    """event_id, user_id, in_window, allowed of a stream of events(user_id, ts, event_id) once the watermark has passed them; rows later than that are dropped."""
    return _by_user(events, late).transformWithStateInPandas(RateLimit(seconds, limit), "event_id long, user_id long, in_window long, allowed boolean", "append", "eventTime")


def lost(events: DataFrame, timeout: int = 3600, late: str = "2 hours") -> DataFrame:
    """user_id, event_id, last_us, lost_us: each time that a user was silent for `timeout` seconds, once the watermark is past that; a later sign begins anew."""
    return _by_user(events, late).transformWithStateInPandas(Heartbeat(timeout), "user_id long, event_id long, last_us long, lost_us long", "append", "eventTime")


def lost_in(events: DataFrame, mark_ms: int, timeout: int = 3600) -> DataFrame:
    """The batch form of lost(), as of a watermark."""
    at = F.unix_micros("ts")
    following = F.lead(at).over(W.partitionBy("user_id").orderBy(at, "event_id"))
    gone = at + timeout * 1_000_000
    over = F.coalesce(following - at >= timeout * 1_000_000, F.lit(True)) & (F.ceil(gone / 1000) < mark_ms)
    # Rows that have not settled are no sign yet.
    settled = events.filter(F.ceil(at / 1000) < mark_ms)
    return settled.withColumn("__over", over).filter("__over").select("user_id", "event_id", at.alias("last_us"), gone.alias("lost_us"))
