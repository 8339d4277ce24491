"""Bounded per-key state on streams: last messages and live cache entries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketlake.streaming.limits import let_go


MESSAGE, EVENT = Row("session_id", "turn", "role", "content"), Row("key", "response", "event")


class RecentMessages(StatefulProcessor):
    """The last messages of a session as list state; a timer forgets a silent session."""

    def __init__(self, n: int, ttl_seconds: int):
        self.n, self.ttl_ms = n, 1000 * ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "turn long, role string, content string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = list(rows)  # the messages of one session in one batch
        held = sorted([*map(tuple, self.held.get()), *((r["turn"], r["role"], r["content"]) for r in arrived)], key=lambda m: m[0])[-self.n :]
        self.held.put(held)
        last = max(int(r["ts"].timestamp() * 1000) for r in arrived)
        let_go(self.handle, max(last, timerValues.getCurrentWatermarkInMs()) + self.ttl_ms)
        return iter([MESSAGE(key[0], *m) for m in held])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_messages_stream(messages: DataFrame, n: int = 10, ttl_seconds: int = 86400) -> DataFrame:
    """messages(session_id string, turn, ts, role, content) with a watermark: the last n per session, on every change.

    A session without messages for the time to live is forgotten.
    """
    schema = "session_id string, turn long, role string, content string"
    return messages.groupBy("session_id").transformWithState(RecentMessages(n, ttl_seconds), schema, "update", "EventTime")


class LiveEntry(StatefulProcessor):
    """The newest response of a cache key and when it ends as value state; a timer reports the end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "response string, expires_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = sorted(rows, key=lambda r: r["ts"])
        newest = arrived[-1]
        entry = (newest["response"], int(newest["ts"].timestamp() * 1000) + 1000 * newest["ttl_s"])
        before = self.entry.get()
        if before and before[1] > entry[1]:
            entry = tuple(before)
        self.entry.update(entry)
        let_go(self.handle, max(entry[1], timerValues.getCurrentWatermarkInMs() + 1))
        return iter([EVENT(key[0], r["response"], "put") for r in arrived])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        response = self.entry.get()[0]
        self.entry.clear()
        return iter([EVENT(key[0], response, "expired")])

    def close(self) -> None:
        pass


def cache_stream(puts: DataFrame) -> DataFrame:
    """puts(key string, response string, ts, ttl_s) with a watermark: "put" on arrival and "expired" once the
    watermark passes the time to live of the newest entry."""
    return puts.groupBy("key").transformWithState(LiveEntry(), "key string, response string, event string", "append", "EventTime")


def first_signups(signups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First row per email within the watermark; for all time use append_new in foreachBatch."""
    return signups.dropDuplicatesWithinWatermark(keys or ["email"])


def earliest(signups: DataFrame, key: str = "email", ts: str = "joined_at", tie: str = "waitlist_id") -> DataFrame:
    """Batch form: the earliest row per key."""
    others = [c for c in signups.columns if c != key]
    return signups.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(ts, tie)).alias("_r")).select(key, "_r.*")
