"""Response cache as a table: exact and semantic lookup, expiry and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.constants import CACHE_THRESHOLD
from docketlake.functions.text import cache_key
from docketlake.operators.analytics import strip_internal
from docketlake.operators.fusion import complexity_value
from docketlake.operators.vectors import nearest_above


def cache_rows(responses: DataFrame, ttl: Column | None = None) -> DataFrame:
    """Rows ready to append: key, response without internal keys, expiry by complexity."""
    seconds = complexity_value("ttl") if ttl is None else ttl
    return responses.select(
        "*", cache_key("query").alias("key"), seconds.alias("ttl_s"),
        (F.col("created_at") + F.make_dt_interval(secs=seconds)).alias("expires_at"),
    ).withColumn("response", strip_internal("response"))


def live(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > as_of)


def cache_append(responses: DataFrame, path: str, ttl: Column | None = None) -> DataFrame:
    """Add responses to the cache table at ``path``. Nothing is rewritten: at lookup the newest live entry of a key wins."""
    rows = cache_rows(responses, ttl)
    rows.write.mode("append").parquet(path)
    return rows


def exact_lookup(requests: DataFrame, cache: DataFrame, value: str = "response", as_of: Column | None = None) -> DataFrame:
    """requests(query_id, user_type, query) with the newest entry of the same key; with ``as_of``, among the live ones.

    Of entries made at the same time the one with the greater value wins.
    """
    found = cache if as_of is None else live(cache, as_of)
    newest = found.groupBy("user_type", "key").agg(F.max_by(value, F.struct("created_at", value)).alias(value))
    return requests.withColumn("key", cache_key("query")).join(newest, ["user_type", "key"], "left")


def two_level_lookup(
    requests: DataFrame, cache: DataFrame, threshold: float = CACHE_THRESHOLD, cells: int = 64, as_of: Column | None = None
) -> DataFrame:
    """requests(query_id, user_type, key, embedding) against cache(item_id, user_type, key, embedding).

    With ``as_of``, entries that have expired by then are not served (expires_at). Of several entries with a key the newest
    wins (created_at, where the cache has it; the smaller item_id among equals). Only requests without an exact hit reach the
    vector search.
    """
    cache = cache if as_of is None else live(cache, as_of)
    age = [F.unix_micros(F.col("created_at").cast("timestamp"))] if "created_at" in cache.columns else []
    firsts = cache.groupBy("user_type", "key").agg(F.min_by("item_id", F.struct(*[-a for a in age], "item_id")).alias("exact_id"))
    exact = requests.join(firsts, ["user_type", "key"], "left")
    missed = exact.where(F.col("exact_id").isNull()).select("query_id", "user_type", "embedding")
    near = nearest_above(cache, missed, threshold, by="user_type", cells=cells)
    return exact.select("query_id", "user_type", "exact_id").join(near, "query_id", "left").select(
        "query_id", "user_type",
        F.coalesce("exact_id", "item_id").alias("item_id"),
        F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("item_id").isNotNull(), "semantic").otherwise("miss").alias("hit_type"),
        F.when(F.col("exact_id").isNull(), F.col("score")).alias("similarity"),
    )


def cache_statistics(lookups: DataFrame) -> DataFrame:
    def n(kind):
        return F.count(F.when(F.col("hit_type") == kind, 1))

    return lookups.agg(
        F.count("*").alias("total_requests"), n("exact").alias("exact_hits"), n("semantic").alias("semantic_hits"),
        n("miss").alias("misses"),
        F.coalesce(F.avg((F.col("hit_type") != "miss").cast("double")), F.lit(0.0)).alias("hit_rate"),
    )
