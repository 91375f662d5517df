"""Stateful streams: events once each, and sessions with their events in order (N10, N11, 2.11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

SESSIONS = "key string, session long, started timestamp, ended timestamp, events long"
STATE = StructType([StructField(c, LongType()) for c in ("session", "started", "ended", "events")])


def once(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key's first event alone; events behind the watermark go. State is held for as long as a repeat can still come."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class Sessions(StatefulProcessor):
    """Of a key: the open session (number, first and last time in microseconds, events). A session ends when the watermark passes its last event by the gap."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _row(self, key: tuple, state: tuple) -> dict:
        number, first, last, n = state
        return {"key": key[0], "session": number, "started": pd.Timestamp(first, unit="us"), "ended": pd.Timestamp(last, unit="us"), "events": n}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        done = []
        # Times alone are held, of one key's rows of one micro-batch.
        for at in sorted(t for frame in rows for t in frame["us"].tolist()):
            if state is None or not state[3]:
                state = (state[0] if state else 1, at, at, 1)
            elif at - state[2] > self.gap:
                done.append(self._row(key, state))
                state = (state[0] + 1, at, at, 1)
            else:
                state = (state[0], min(state[1], at), max(state[2], at), state[3] + 1)
        self.open.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((state[2] + self.gap) // 1000 + 1)
        yield pd.DataFrame(done, columns=["key", "session", "started", "ended", "events"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        # The number goes on; an empty session marks the place.
        if state is not None and state[3]:
            self.open.update((state[0] + 1, 0, 0, 0))
            yield pd.DataFrame([self._row(key, state)])
        else:
            yield pd.DataFrame(columns=["key", "session", "started", "ended", "events"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, key: str, time: str = "ts", gap_minutes: float = 30, late: str = "10 minutes", unique: str | None = "event_id") -> DataFrame:
    """A stream of events to a stream of their ended sessions (key, session 1, 2, ..., started, ended, events).

    A session holds events of a key that lie at most the gap apart. Events with a key seen before (unique) or behind the
    watermark don't count. State is a row for each key; the stream needs the RocksDB state store. A query that is started
    again from its checkpoint goes on where it was.
    """
    own = once(events, unique, time, late) if unique else events.withWatermark(time, late)
    keyed = own.select(F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).alias("us"))
    return keyed.groupBy("key").transformWithStateInPandas(Sessions(int(gap_minutes * 60_000_000)), SESSIONS, "Append", "EventTime")


def stored_sessions(events: DataFrame, path: str, checkpoint: str, **more) -> None:
    """Run the stream of sessions over what is there now, into path; a later run goes on from the checkpoint."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sessions(events, **more).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
