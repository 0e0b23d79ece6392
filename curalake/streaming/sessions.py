"""Keyed state with timers: a store of sessions with optimistic revisions (T12), and the last value of each burst of input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: What a store answers to writes: key, pos of the write (null for a sweep), at (milliseconds), what happened, and the revision then.
ANSWERS = "key string, pos long, at long, answer string, revision long"
#: The largest revision: one more than it is itself.
LAST = (1 << 53) - 1


#: Keys share so many states.
BUCKETS = 4096


class SessionStore(StatefulProcessor):
    """One session for each key: its revision and the time of its last write. A state holds the sessions of the keys of a bucket.

    A write names the revision that it was made from (0 for none). On a live session it is saved only if that is the session's
    revision, and is a conflict otherwise; where there is no session, or one whose time is over, it revives it one past
    the revision that it names. A session's time is over ttl milliseconds after its last write, and a timer then sweeps it.
    The timer of a bucket is that of the session which ends first.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "keys array<string>, revisions array<long>, saved array<long>")

    def _read(self) -> dict[str, tuple[int, int]]:
        """Revision and last write by key."""
        held = self.state.get()
        return {k: (r, s) for k, r, s in zip(*held)} if held else {}

    def _end(self, sessions: dict[str, tuple[int, int]]) -> int | None:
        return min(s for _, s in sessions.values()) + self.ttl if sessions else None

    def _write(self, sessions: dict[str, tuple[int, int]]) -> None:
        if sessions:
            self.state.update((list(sessions), [r for r, _ in sessions.values()], [s for _, s in sessions.values()]))
        else:
            self.state.clear()

    def _swept(self, user: str, revision: int, saved: int) -> tuple:
        return (user, None, saved + self.ttl, "swept", revision)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions = self._read()
        before = self._end(sessions)
        out = []
        for user, at, pos, base in sorted((k, int(t), int(p), int(b)) for part in rows for k, t, p, b in zip(part["key"], part["at_ms"], part["pos"], part["base"])):
            stored = sessions.get(user)
            if stored and stored[1] + self.ttl <= at:
                out.append(self._swept(user, *stored))
                stored = None
            if stored and base != stored[0]:
                out.append((user, pos, at, "conflict", stored[0]))
                continue
            answer = "saved" if stored or not base else "revived"
            sessions[user] = (min(base + 1, LAST), at)
            out.append((user, pos, at, answer, sessions[user][0]))
        self._write(sessions)
        self._move_timer(before, self._end(sessions))
        yield _answers(out)

    def _move_timer(self, before: int | None, after: int | None) -> None:
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._read()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = {k: s for k, s in sessions.items() if s[1] + self.ttl <= now}
        if over:
            left = {k: s for k, s in sessions.items() if k not in over}
            self._write(left)
            self._move_timer(None, self._end(left))  # the one that came is gone
        yield _answers([self._swept(k, *s) for k, s in over.items()])

    def close(self) -> None:
        pass


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "pos", "at", "answer", "revision"]).astype({"pos": "Int64"})


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stored_sessions(writes: DataFrame, key: str, at: str, pos: str, base: str, ttl: int, delay: str) -> DataFrame:
    """Answers to a stream of writes, and sweeps, as the watermark (delay behind the newest write) passes the end of a session.

    Writes of a key are taken in the order of their time inside a micro-batch. Null keys are one key, the empty text.
    Python is called for buckets of keys, so that its calls don't grow with the keys; a bucket's state is written as a whole.
    """
    rows = writes.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(pos).cast("long").alias("pos"), F.col(base).cast("long").alias("base"))
    rows = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(SessionStore(ttl), ANSWERS, "Append", "EventTime")


def settled_inputs(stream: DataFrame, key: str, at: str, pos: str, value: str, gap: str, delay: str) -> DataFrame:
    """The last value of each burst of a key, trimmed; a burst ends when nothing has come for `gap`."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    burst = rows.groupBy(F.session_window(at, gap).alias("burst"), key).agg(F.max_by(value, F.struct(at, pos)).alias("value"), F.count("*").alias("n"))
    return burst.select(key, F.unix_micros("burst.start").alias("start"), F.trim("value").alias("value"), "n")
