"""Windowed summaries that run unchanged on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rolling_summary(log: DataFrame, window: str = "24 hours", slide: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Queries, users, mean response time, success rate and feedback per sliding window."""
    stream = log.isStreaming
    source = log.withWatermark("ts", watermark) if stream else log
    users = F.approx_count_distinct("user_id") if stream else F.countDistinct("user_id")

    def rated(r):
        return F.count(F.when(F.col("rating") == r, 1))

    return source.groupBy(F.window("ts", window, slide)).agg(
        F.count("*").alias("total_queries"), users.alias("unique_users"), F.avg("response_time_ms").alias("avg_response_time_ms"),
        F.avg((F.col("status") == "success").cast("double")).alias("success_rate"),
        rated(1).alias("positive"), rated(0).alias("neutral"), rated(-1).alias("negative"),
    ).select(F.col("window.start").alias("window_start"), "*").drop("window")


def profile_counters(log: DataFrame) -> DataFrame:
    """Running counters per user, for update mode: log(user_id, ts, area, complexity, user_type)."""
    return log.groupBy("user_id").agg(
        F.count("*").alias("query_count"), F.max("ts").alias("updated_at"),
        F.max_by("complexity", F.struct("ts", "complexity")).alias("last_query_complexity"),
        F.max_by("user_type", F.struct("ts", "user_type")).alias("detected_user_type"),
        F.array_sort(F.collect_set("area")).alias("legal_interests"),
    )


def sessions(messages: DataFrame, key: str = "user_id", gap: str = "24 hours", watermark: str = "24 hours") -> DataFrame:
    """Sessions where none is given: messages closer than the gap belong together."""
    source = messages.withWatermark("ts", watermark) if messages.isStreaming else messages
    return source.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("messages")).select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "messages"
    )
