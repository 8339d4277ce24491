"""Conversation memory and user profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docketlake.operators.fusion import top_k

LAST_MESSAGES = 10


def last_messages(messages: DataFrame, n: int = LAST_MESSAGES, session: str = "session_id", order: str = "turn") -> DataFrame:
    return top_k(messages, n, [session], [F.desc(order)], "recency")


def recent_context(messages: DataFrame, max_tokens: int = 2000, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Newest stored messages whose summed length // 4 stays within the budget; sort by ``order`` to read."""
    stored = last_messages(messages, session=session, order=order).withColumn(
        "tokens", F.floor(F.length("content") / 4).cast("int")
    )
    newest_first = W.partitionBy(session).orderBy("recency").rowsBetween(W.unboundedPreceding, W.currentRow)
    return stored.withColumn("used", F.sum("tokens").over(newest_first)).where(F.col("used") <= max_tokens)


def exchanges(context: DataFrame, n: int = 3, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Last n exchanges: a user message opens one, the last assistant message in it completes it."""
    upto = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = context.where(F.col("role").isin("user", "assistant")).withColumn(
        "exchange", F.sum((F.col("role") == "user").cast("int")).over(upto)
    )
    pairs = numbered.groupBy(session, "exchange").agg(
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("user"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("content")),
                 F.when(F.col("role") == "assistant", F.col(order))).alias("assistant"),
    )
    return top_k(pairs, n, [session], [F.desc("exchange")], "recency")


def profiles(log: DataFrame) -> DataFrame:
    """log(user_id, ts, areas, complexity, user_type) to counters, interests and the latest values per user."""
    first_area = log.where(F.size("areas") > 0).groupBy("user_id", F.get("areas", F.lit(0)).alias("area")).agg(
        F.count("*").alias("n")
    )
    frequency = first_area.groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("area", "n")))).alias("area_frequency")
    )
    interests = log.select("user_id", F.explode("areas").alias("area")).groupBy("user_id").agg(
        F.array_sort(F.collect_set("area")).alias("legal_interests")
    )
    latest = F.struct("ts", "event_id")
    base = log.groupBy("user_id").agg(
        F.count("*").alias("query_count"),
        F.max_by("complexity", latest).alias("last_query_complexity"),
        F.max_by("user_type", latest).alias("detected_user_type"),
        F.max("ts").alias("updated_at"),
    )
    return base.join(frequency, "user_id", "left").join(interests, "user_id", "left")


def personalization(profile: DataFrame, k: int = 5) -> DataFrame:
    """Top areas by frequency, query count and the returning flag."""
    entries = F.transform(F.map_entries("area_frequency"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("area")))
    top = F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: e["area"])
    return profile.select(
        "user_id",
        F.lit("citizen").alias("expertise_level"), F.lit("moderate").alias("typical_complexity"),
        F.coalesce(top, F.array().cast("array<string>")).alias("top_legal_interests"),
        "query_count", (F.col("query_count") > 5).alias("is_returning_user"),
    )


def combined_memory(messages: DataFrame, personal: DataFrame, max_tokens: int = 2000, session: str = "session_id") -> DataFrame:
    """Tokens of conversation (70 % of the budget) and profile per session; messages carry user_id."""
    recent = recent_context(messages, int(max_tokens * 0.7), session)
    talk = recent.groupBy(session).agg(F.sum("tokens").alias("short_term"), F.count("*").alias("messages"))
    users = messages.select(session, "user_id").distinct()
    quoted = F.array_join(F.transform("top_legal_interests", lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", ")
    shown = F.concat(
        F.lit("{'expertise_level': '"), "expertise_level", F.lit("', 'typical_complexity': '"), "typical_complexity",
        F.lit("', 'top_legal_interests': ["), quoted, F.lit("], 'query_count': "), F.col("query_count").cast("string"),
        F.lit(", 'is_returning_user': "), F.initcap(F.col("is_returning_user").cast("string")), F.lit("}"),
    )
    known = personal.select("user_id", F.floor(F.length(shown) / 4).cast("int").alias("long_term"))
    zero = F.lit(0)
    return (
        users.join(talk, session, "left").join(known, "user_id", "left")
        .withColumns({c: F.coalesce(F.col(c), zero) for c in ("short_term", "long_term", "messages")})
        .withColumn("total", F.col("short_term") + F.col("long_term"))
    )
