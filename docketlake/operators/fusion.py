"""Ranking, merging and selecting hits per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketlake.constants import (
    COMPLEXITY,
    DEFAULT_COMPLEXITY,
    DIVERSITY_SHARE,
    FALLBACK_TOP_K,
    MIN_RERANK_SCORE,
    PREFETCH_TOP_K,
    RRF_C,
    RRF_WEIGHTS,
)
from docketlake.session import materialize


def top_k(df: DataFrame, k: int | Column, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """First k rows per key; with a fixed k Catalyst limits every group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def union_branches(**branches: DataFrame) -> DataFrame:
    """Hits of several searches, each row marked with its branch in ``source``."""
    out = None
    for name, hits in branches.items():
        hits = hits.withColumn("source", F.lit(name))
        out = hits if out is None else out.unionByName(hits, allowMissingColumns=True)
    return out


def merge_best(hits: DataFrame, arrival: list[Column] | None = None) -> DataFrame:
    """One row per query and chunk: the highest score, the earliest arrival on ties.

    An aggregate instead of a window: partial maxima are taken before the shuffle.
    """
    order = F.struct(F.col("score"), *[(-c) for c in (arrival or [])])
    others = [c for c in hits.columns if c not in ("query_id", "chunk_id")]
    return (
        hits.groupBy("query_id", "chunk_id")
        .agg(F.max_by(F.struct(*others), order).alias("_best"))
        .select("query_id", "chunk_id", *[F.col(f"_best.{c}").alias(c) for c in others])
    )


def spread_rank(df: DataFrame, keys: list[str], score: str = "score", tie: str = "chunk_id", bands: int = 32) -> DataFrame:
    """row_number by descending score per key, without ordering a whole group in one task.

    Approximate quantiles cut every group into bands; rows are ordered inside their band and the
    sizes of the bands above are added. Where the cuts lie does not change the result.
    """
    cuts = [i / bands for i in range(1, bands)]
    bounds = materialize(df.groupBy(*keys).agg(F.percentile_approx(score, cuts, 1000).alias("_cuts")), "bands")
    banded = df.join(bounds, keys).withColumn("_band", F.size(F.filter("_cuts", lambda c: c > F.col(score)))).drop("_cuts")
    sizes = banded.groupBy(*keys, "_band").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_band", F.coalesce(above, F.lit(0)).alias("_above"))
    inside = F.row_number().over(W.partitionBy(*keys, "_band").orderBy(F.desc(score), F.asc(tie)))
    return banded.join(offsets, [*keys, "_band"]).withColumn("rank", F.col("_above") + inside).drop("_band", "_above")


def rank_fusion(
    hits: DataFrame, weights: dict[str, float] | None = None, c: int = RRF_C, rank: str | None = None
) -> DataFrame:
    """Weighted reciprocal ranks summed over branches. Give ``rank`` if the hits carry it already."""
    weights = weights or RRF_WEIGHTS
    if rank is None:
        rank, hits = "rank", spread_rank(hits, ["query_id", "source"])
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(value)).otherwise(weight)
    return hits.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(weight / (F.lit(c) + F.col(rank))), 9).alias("score"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
    )


def merge_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hits per branch and the share that survives merging, per query."""
    counts = before.groupBy("query_id").agg(
        F.count(F.when(F.col("source") == "bm25", 1)).alias("bm25_count"),
        F.count(F.when(F.col("source") == "dense", 1)).alias("dense_count"),
        F.count("*").alias("total"),
    )
    kept = after.groupBy("query_id").agg(F.count("*").alias("combined_count"))
    return counts.join(kept, "query_id", "left").withColumn(
        "dedupe_ratio", F.coalesce(F.col("combined_count"), F.lit(0)) / F.col("total")
    )


def complexity_value(column: str, complexity: Column | str = "complexity") -> Column:
    """Per-complexity setting: retrieve, keep, ttl or answer_tokens; unknown levels count as moderate."""
    position = {"retrieve": 1, "keep": 2, "ttl": 3, "answer_tokens": 4}[column]
    c = F.col(complexity) if isinstance(complexity, str) else complexity
    table = {row[0]: row[position] for row in COMPLEXITY}
    value = F.lit(table[DEFAULT_COMPLEXITY])
    for level, setting in table.items():
        value = F.when(c == level, F.lit(setting)).otherwise(value)
    return value


def adaptive_top_k(hits: DataFrame, setting: str = "retrieve", complexity: str = "complexity") -> DataFrame:
    """top_k with the per-query limit of its complexity; the largest limit prunes before the shuffle."""
    largest = max(row[1] if setting == "retrieve" else row[2] for row in COMPLEXITY)
    ranked = top_k(hits, largest, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
    return ranked.where(F.col("rank") <= complexity_value(setting, complexity))


def final_select(hits: DataFrame, min_score: float = MIN_RERANK_SCORE, complexity: str = "complexity") -> DataFrame:
    return adaptive_top_k(hits.where(F.col("score") >= min_score), "keep", complexity)


def fallback_select(hits: DataFrame, k: int = FALLBACK_TOP_K) -> DataFrame:
    """Plain score order, used where no reranking scores exist."""
    return top_k(hits, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])


def diversify(ranked: DataFrame, target: Column | int, parent: str = "doc_id", rank: str = "rank") -> DataFrame:
    """At most max(2, 40 %) of the target from one parent, then filled up in rank order.

    A query with no more hits than the target is left as it is.
    """
    target = F.lit(target) if isinstance(target, int) else target
    share = F.floor(target * F.lit(DIVERSITY_SHARE) + F.lit(1e-9)).cast("int")
    cap = F.greatest(F.lit(2), share)
    per_parent = W.partitionBy("query_id", parent).orderBy(rank)
    per_query = W.partitionBy("query_id")
    flagged = (
        ranked.withColumn("_within", F.row_number().over(per_parent))
        .withColumn("_total", F.count("*").over(per_query))
        .withColumn("_over", (F.col("_total") > target) & (F.col("_within") > cap))
    )
    placed = flagged.withColumn("position", F.row_number().over(per_query.orderBy("_over", rank)))
    return placed.where((F.col("position") <= target) | (F.col("_total") <= target)).drop(
        "_within", "_total", "_over"
    )


def prefetch_parents(ranked: DataFrame, k: int = PREFETCH_TOP_K) -> DataFrame:
    """Distinct parents of the leading hits."""
    return ranked.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()


def add_unseen(existing: DataFrame, extra: DataFrame) -> DataFrame:
    """Existing hits plus the follow-up hits whose chunk the query does not have yet; iteration counts up."""
    fresh = extra.join(existing.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    fresh = fresh.dropDuplicates(["query_id", "chunk_id"])
    return existing.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def rerank_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores before and after reranking, per query."""
    b = before.groupBy("query_id").agg(F.avg("score").alias("avg_before"), F.count("*").alias("candidates"))
    a = after.groupBy("query_id").agg(
        F.avg("score").alias("avg_after"),
        F.min("score").alias("min_after"),
        F.max("score").alias("max_after"),
        F.countDistinct("doc_id").alias("parents"),
        F.count("*").alias("kept"),
    )
    zero = F.lit(0.0)
    return b.join(a, "query_id", "left").select(
        "query_id", "candidates",
        F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce("parents", F.lit(0)).alias("parents"),
        F.round("avg_before", 3).alias("avg_before"),
        F.round(F.coalesce("avg_after", zero), 3).alias("avg_after"),
        F.round(F.coalesce("avg_after", zero) - F.col("avg_before"), 3).alias("improvement"),
        F.round(F.coalesce("min_after", zero), 3).alias("min_after"),
        F.round(F.coalesce("max_after", zero), 3).alias("max_after"),
    )


def search_confidence(ranked: DataFrame, rank: str = "rank", score: str = "confidence") -> DataFrame:
    """Position-weighted mean per query: .5, .3, .2, then .1 each; one hit keeps its own confidence."""
    r = F.col(rank)
    w = F.when(r == 1, 0.5).when(r == 2, 0.3).when(r == 3, 0.2).otherwise(0.1)
    return ranked.groupBy("query_id").agg(
        F.when(F.count("*") == 1, F.max(score))
        .otherwise(F.round(F.sum(F.col(score) * w) / F.sum(w), 3))
        .alias("search_confidence")
    )
