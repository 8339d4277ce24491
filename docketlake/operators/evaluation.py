"""Scoring answers and retrieval against golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.functions.text import _c, words


def answer_similarity(actual: Column | str, expected: Column | str) -> Column:
    """Share of the expected distinct words that the answer contains."""
    a = F.array_distinct(words(F.lower(F.coalesce(_c(actual), F.lit("")))))
    e = F.array_distinct(words(F.lower(F.coalesce(_c(expected), F.lit("")))))
    return F.when(F.size(e) > 0, F.size(F.array_intersect(a, e)) / F.size(e)).otherwise(F.lit(0.0))


def latency_score(ms: Column | str) -> Column:
    """1 up to 5 s, 0 from 10 s, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - (_c(ms) - 5000) / 5000))


def citation_accuracy(actual: Column | str, expected: Column | str) -> Column:
    """Share of expected sources contained in any actual source, ignoring case."""
    a, e = F.transform(_c(actual), F.lower), F.transform(_c(expected), F.lower)
    found = F.filter(e, lambda x: F.exists(a, lambda y: F.contains(y, x)))
    return F.when(F.size(e) == 0, F.lit(1.0)).otherwise(F.size(found) / F.size(e))


def score_answers(golden: DataFrame, results: DataFrame) -> DataFrame:
    """golden(id, ...) joined with results(id, answer, sources, latency_ms, confidence) and scored."""
    return golden.join(results, "id").withColumns({
        "correctness": answer_similarity("answer", "expected_answer"),
        "citation": citation_accuracy("sources", "expected_sources"),
        "performance": latency_score("latency_ms"),
    }).withColumns({
        "overall": F.col("correctness") * 0.5 + F.col("citation") * 0.3 + F.col("performance") * 0.2,
        "passed": (F.col("correctness") >= 0.7) & (F.col("citation") >= 0.6)
        & (F.col("confidence") >= F.col("expected_confidence_min")) & (F.col("latency_ms") <= 10000),
    })


def golden_summary(scored: DataFrame) -> DataFrame:
    """One row of averages with the 0.9, 0.95 and 5000 ms gates."""
    s = scored.agg(
        F.count("*").alias("total_queries"), F.sum(F.col("passed").cast("long")).alias("passed_queries"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("correctness").alias("avg_correctness"),
        F.avg("citation").alias("avg_citation"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg("confidence").alias("avg_confidence"),
    )
    gates = {
        "correctness_passed": F.col("avg_correctness") >= 0.9, "citation_passed": F.col("avg_citation") >= 0.95,
        "latency_passed": F.col("avg_latency_ms") <= 5000,
    }
    return s.withColumns(gates).withColumn(
        "overall_passed", F.col("correctness_passed") & F.col("citation_passed") & F.col("latency_passed")
    )


def category_breakdown(scored: DataFrame) -> DataFrame:
    """Per category and in total, in one pass; the total's category is "(all)"."""
    return scored.rollup("category").agg(
        F.when(F.grouping("category") == 1, "(all)").otherwise(F.first("category")).alias("_c"),
        F.count("*").alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("overall").alias("avg_score"), F.avg("latency_ms").alias("avg_latency"),
    ).drop("category").withColumnRenamed("_c", "category")


def precision_at_k(retrieved: Column | str, expected: Column | str, k: int) -> Column:
    """Share of expected topics that contain, or are contained in, one of the first k retrieved topics."""
    r = F.array_distinct(F.transform(F.slice(_c(retrieved), 1, k), F.lower))
    e = F.array_distinct(F.transform(_c(expected), F.lower))
    hit = F.filter(e, lambda x: F.exists(r, lambda y: F.contains(y, x) | F.contains(x, y)))
    return F.when((F.size(r) > 0) & (F.size(e) > 0), F.size(hit) / F.size(e)).otherwise(F.lit(0.0))


def doc_type_jaccard(retrieved: Column | str, expected: Column | str) -> Column:
    r, e = _c(retrieved), _c(expected)
    union = F.size(F.array_union(r, e))
    return F.when((F.size(r) > 0) & (union > 0), F.size(F.array_intersect(r, e)) / union).otherwise(F.lit(0.0))


def retrieval_summary(scored: DataFrame, baseline: tuple[float, float] | None = None) -> DataFrame:
    """Mean precision and type match in total, per complexity and per rerank method, in one pass.

    ``baseline`` is (precision at 5, precision at 10) and adds the relative change in per cent.
    """
    level = F.grouping_id()
    out = scored.groupingSets([[], ["complexity"], ["rerank_method"]], "complexity", "rerank_method").agg(
        level.alias("_g"), F.count("*").alias("n"), F.avg("precision_5").alias("avg_precision_5"),
        F.avg("precision_10").alias("avg_precision_10"), F.avg("doc_type_score").alias("avg_doc_type_match"),
    )
    total = scored.agg(F.count("*").alias("n")).scalar()
    out = out.select(
        F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "complexity").otherwise("rerank_method").alias("scope"),
        F.coalesce("complexity", "rerank_method", F.lit("(all)")).alias("value"),
        "n", F.round(F.col("n") / total * 100, 1).alias("share_pct"),
        *[F.round(c, 3).alias(c) for c in ("avg_precision_5", "avg_precision_10", "avg_doc_type_match")],
    )
    if baseline:
        for c, b in zip(("avg_precision_5", "avg_precision_10"), baseline):
            out = out.withColumn(f"{c}_change_pct", F.round((F.col(c) - b) / b * 100, 1))
    return out


def trigger_rates(decisions: DataFrame) -> DataFrame:
    """Share of decisions other than pass and fail, per complexity and overall, with the decision counts."""
    triggered = F.col("decision").isin("refine_synthesis", "retrieve_more").cast("double")

    def n(kind):
        return F.count(F.when(F.col("decision") == kind, 1)).alias(kind)

    return decisions.rollup("complexity").agg(
        F.when(F.grouping("complexity") == 1, "(all)").otherwise(F.first("complexity")).alias("level"),
        F.count("*").alias("n"), F.round(F.avg(triggered) * 100, 4).alias("trigger_rate"),
        n("pass"), n("fail"), n("refine_synthesis"), n("retrieve_more"),
    ).drop("complexity")
