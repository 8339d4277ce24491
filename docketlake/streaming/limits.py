"""Request limits and bans per client. Only admitted requests count, so the decision depends on the
earlier decisions: a fold over each client's requests in time order, in batch and as a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketlake.constants import BAN_SECONDS

DECIDED = Row("client", "request_id", "status", "retry_after")


class Gate:
    """State of one client: admitted times inside the longest window and the end of a ban."""

    def __init__(self, limits: list[tuple[int, int]], ban_seconds: int, times=(), banned_until: float = 0.0):
        self.limits, self.ban_seconds = limits, ban_seconds
        self.horizon = max(seconds for _, seconds in limits)
        self.times, self.banned_until = deque(times), banned_until

    def decide(self, now: float, flagged: bool) -> tuple[str, int]:
        if now < self.banned_until:
            return "banned", int(self.banned_until - now) + 1
        while self.times and now - self.times[0] >= self.horizon:
            self.times.popleft()
        for most, seconds in self.limits:
            inside = [x for x in self.times if now - x < seconds]
            if len(inside) >= most:
                return "limited", int(seconds - (now - inside[0])) + 1
        self.times.append(now)
        if flagged:
            self.banned_until = now + self.ban_seconds
            return "bot", self.ban_seconds
        return "admitted", 0


def quiet_segments(requests: DataFrame, gap: float, bucket: float) -> DataFrame:
    """Number each client's stretches without a pause of ``gap`` seconds.

    After such a pause no earlier request matters, so every stretch is an independent task and a busy
    client spreads over the cluster. Pauses are found inside time buckets; only one row per client and
    bucket is ordered along the whole client.
    """
    rows = requests.withColumn("_b", F.floor(F.col("_sec") / bucket))
    edges = rows.groupBy("client", "_b").agg(F.max("_sec").alias("_last"))
    along = W.partitionBy("client").orderBy("_b")
    edges = edges.select("client", "_b", F.lag("_last").over(along).alias("_before"))
    inside = W.partitionBy("client", "_b").orderBy("_sec", "request_id")
    rows = rows.join(edges, ["client", "_b"]).withColumn("_prev", F.coalesce(F.lag("_sec").over(inside), F.col("_before")))
    rows = rows.withColumn("_new", (F.col("_prev").isNull() | (F.col("_sec") - F.col("_prev") >= gap)).cast("int"))
    starts = rows.groupBy("client", "_b").agg(F.sum("_new").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("client", "_b", offset.alias("_offset"))
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.join(starts, ["client", "_b"]).withColumn("segment", F.col("_offset") + F.sum("_new").over(upto))
        .drop("_b", "_before", "_prev", "_new", "_offset")
    )


def limit_requests(
    requests: DataFrame, limits: list[tuple[int, int]], ban_seconds: int = BAN_SECONDS, bucket: float = 86400.0
) -> DataFrame:
    """requests(request_id, client, ts [, flagged]) with status admitted, limited, bot or banned, and retry_after.

    ``flagged`` marks honeypot hits. Memory per task is the state of one client.
    """
    if "flagged" not in requests.columns:
        requests = requests.withColumn("flagged", F.lit(False))
    timed = requests.withColumn("_sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    gap = float(max(max(s for _, s in limits), ban_seconds))
    ordered = (
        quiet_segments(timed, gap, max(bucket, gap))
        .repartition("client", "segment").sortWithinPartitions("client", "segment", "_sec", "request_id")
    )
    kept = [c for c in ordered.columns if c != "_sec"]
    schema = T.StructType(ordered.drop("_sec").schema.fields + [T.StructField("status", T.StringType()), T.StructField("retry_after", T.IntegerType())])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, None
        for pdf in frames:
            out = []
            for client, segment, sec, flagged in zip(pdf["client"], pdf["segment"], pdf["_sec"], pdf["flagged"]):
                if (client, segment) != current:
                    current, gate = (client, segment), Gate(limits, ban_seconds)
                out.append(gate.decide(sec, bool(flagged)))
            yield pdf[kept].assign(status=[s for s, _ in out], retry_after=[r for _, r in out])

    return ordered.mapInPandas(fold, schema)


class LimitProcessor(StatefulProcessor):
    """One client's admitted times as list state, the end of its ban as value state, and a timer that lets both go."""

    def __init__(self, limits: list[tuple[int, int]], ban_seconds: int):
        self.limits, self.ban_seconds = limits, ban_seconds
        self.horizon_ms = 1000 * max(max(s for _, s in limits), ban_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", T.StructType([T.StructField("at", T.DoubleType())]))
        self.ban = handle.getValueState("ban", T.StructType([T.StructField("until", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        until = self.ban.get()
        gate = Gate(self.limits, self.ban_seconds, [t[0] for t in self.times.get()], until[0] if until else 0.0)
        arrived = sorted(rows, key=lambda r: (r["sec"], r["request_id"]))  # the requests of one client in one batch
        decided = [DECIDED(key[0], r["request_id"], *gate.decide(r["sec"], bool(r["flagged"]))) for r in arrived]
        self.times.put([(t,) for t in gate.times]) if gate.times else self.times.clear()
        self.ban.update((gate.banned_until,))
        let_go(self.handle, max(int(arrived[-1]["sec"] * 1000), timerValues.getCurrentWatermarkInMs()) + self.horizon_ms + 1)
        return iter(decided)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.times.clear()
        self.ban.clear()
        return iter(())

    def close(self) -> None:
        pass


def let_go(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """Leave a key one timer only."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


def limit_stream(requests: DataFrame, limits: list[tuple[int, int]], ban_seconds: int = BAN_SECONDS) -> DataFrame:
    """The same decisions on a stream with a watermark on ts: client, request_id, status, retry_after.

    A client's state is its admitted times within the longest window; it goes by a timer once the watermark passes it. The
    session needs the state store with column families (``session.build_session`` sets it).
    """
    output = T.StructType([
        T.StructField("client", requests.schema["client"].dataType), T.StructField("request_id", requests.schema["request_id"].dataType),
        T.StructField("status", T.StringType()), T.StructField("retry_after", T.IntegerType()),
    ])
    if "flagged" not in requests.columns:
        requests = requests.withColumn("flagged", F.lit(False))
    timed = requests.withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return timed.groupBy("client").transformWithState(LimitProcessor(limits, ban_seconds), output, "append", "EventTime")
