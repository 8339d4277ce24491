"""Answer and retrieval quality: citations, quotes, gates, routing and scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketlake.constants import (
    COHERENCE_SCORES, CONSTITUTION_TERMS, GRADES, LENGTH_MARKERS, QUALITY_WEIGHTS, STRUCTURE_MARKERS, TRANSITION_WORDS,
)
from docketlake.functions.query import any_of
from docketlake.functions.text import _c, strip, word_count
from docketlake.operators.fusion import top_k

SOURCE_MARK = r"\[Source \d+\]"
INLINE_SOURCE = r"\(Source: [^)]+\)"
QUOTED = r'"([^"]{20,})"'
#: Characters that a quote has at least, and of the grams by which quotes and contexts meet.
QUOTE_CHARS, GRAM = 20, 8


def cited_positions(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per [Source n] marker."""
    found = F.regexp_extract_all(answer, F.lit(r"\[Source (\d+)\]"), F.lit(1))
    return answers.select("query_id", F.posexplode_outer(found).alias("mention", "_n")).where(F.col("_n").isNotNull()).select(
        "query_id", "mention", F.col("_n").cast("int").alias("position")
    )


def resolve_citations(answers: DataFrame, contexts: DataFrame, answer: str = "answer") -> DataFrame:
    """Markers joined to the n-th context of the same query; markers beyond the context are left out."""
    return cited_positions(answers, answer).join(contexts, ["query_id", "position"])


def attribution(answer: Column | str) -> dict[str, Column]:
    """Citations per factual sentence, the 0.33 pass mark and up to five uncited sentences."""
    a = _c(answer)
    factual = F.filter(F.split(a, r"\."), lambda s: (F.length(strip(s)) > 20) & ~strip(s).startswith("⚠️"))
    cited = F.regexp_count(a, F.lit(SOURCE_MARK))
    ratio = cited / F.greatest(F.size(factual), F.lit(1))
    bare = F.transform(
        F.filter(factual, lambda s: ~s.rlike(SOURCE_MARK)), lambda s: F.concat(F.substring(strip(s), 1, 100), F.lit("..."))
    )
    passed = ratio >= 0.33
    return {
        "citation_ratio": ratio, "attributed": passed,
        "missing_citations": F.when(passed, F.array().cast("array<string>")).otherwise(F.slice(bare, 1, 5)),
    }


def citation_density(answer: Column | str) -> dict[str, Column]:
    """Inline citations and how many per 100 words."""
    n = F.regexp_count(_c(answer), F.lit(INLINE_SOURCE))
    return {"citation_count": n, "citation_density": F.round(n / F.greatest(F.lit(1), word_count(answer)) * 100, 2)}


def sampled_grams(text: str, gram: int = GRAM, window: int = QUOTE_CHARS - GRAM + 1) -> np.ndarray:
    """Hashes of the grams with the least hash in each ``window`` of consecutive grams, each once.

    A stretch of window + gram - 1 characters picks the same gram in whatever text it stands.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < gram + window - 1:
        return np.zeros(0, np.int64)
    h = np.zeros(len(points) - gram + 1, np.uint64)
    for k in range(gram):
        h = (h ^ points[k : len(h) + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(1)).view(np.int64)


def _grams(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def grams(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([sampled_grams(t.as_py() or "") for t in column], pa.list_(pa.int64()))

    return grams(text)


def verify_quotes(answers: DataFrame, contexts: DataFrame, answer: str = "answer", content: str = "content") -> DataFrame:
    """Quotes of 20 characters or more that no context of the answer contains, counted, with the first three.

    A quote meets only contexts of its answer that share the gram which the quote's first 20 characters pick, whatever
    stands around them; those few are checked exactly. No quote is paired with every context.
    """
    quotes = answers.select("query_id", F.posexplode_outer(F.regexp_extract_all(answer, F.lit(QUOTED), F.lit(1))).alias("n", "quote"))
    quotes = quotes.where(F.col("quote").isNotNull()).withColumn("_low", F.lower("quote"))
    asked = quotes.select("query_id", "n", "_low", F.explode_outer(_grams(F.substring("_low", 1, QUOTE_CHARS))).alias("_gram"))
    texts = contexts.select("query_id", F.lower(content).alias("_content")).where(F.col("_content").isNotNull()).withColumn("_id", F.xxhash64("_content"))
    held = texts.select("query_id", "_id", F.explode_outer(_grams(F.col("_content"))).alias("_gram"))
    met = asked.join(held, ["query_id", "_gram"]).select("query_id", "n", "_low", "_id")
    found = met.join(texts, ["query_id", "_id"]).where(F.contains("_content", "_low")).select("query_id", "n", F.lit(True).alias("_ok")).distinct()
    marked = quotes.join(found, ["query_id", "n"], "left").withColumn("_bad", F.col("_ok").isNull())
    counts = marked.groupBy("query_id").agg(
        (F.count_if("_bad") == 0).alias("all_verified"), F.count_if(~F.col("_bad")).alias("verified_count")
    )
    shown = F.when(F.length("quote") > 100, F.concat(F.substring("quote", 1, 100), F.lit("..."))).otherwise(F.col("quote"))
    three = top_k(marked.where("_bad").select("query_id", "n", shown.alias("q")), 3, ["query_id"], [F.asc("n")])
    listed = three.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda x: x["q"]), " | ").alias("_q"))
    return counts.join(listed, "query_id", "left").select("query_id", "all_verified", "verified_count", F.coalesce("_q", F.lit("")).alias("unverified_quotes"))


def clarity_score(answer: Column | str) -> Column:
    a = _c(answer)
    score = (
        F.lit(1.0) - F.when(any_of(a, STRUCTURE_MARKERS), 0.0).otherwise(0.3)
        - F.when(any_of(F.lower(a), TRANSITION_WORDS), 0.0).otherwise(0.2)
        - F.when((F.length(a) > 2000) & ~any_of(a, LENGTH_MARKERS), 0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), score)


def constitution_aware(answer: Column | str) -> Column:
    return any_of(_c(answer), CONSTITUTION_TERMS)


def hierarchy_check(answer: Column | str, doc_types: Column | str) -> dict[str, Column]:
    """Constitution before statutes where both are among the sources, and citations for half of the sources."""
    a, kinds = _c(answer), _c(doc_types)
    c, s = F.instr(a, "Constitution"), F.instr(a, "Act")
    order = F.array_contains(kinds, "constitution") & F.array_contains(kinds, "act") & (c > 0) & (s > 0) & (s < c)
    few = F.regexp_count(a, F.lit(INLINE_SOURCE)) < F.size(kinds) * 0.5
    issues = F.array_compact(F.array(
        F.when(order, "Constitutional provisions should be discussed before statutory provisions"),
        F.when(few, "Insufficient citations for provided authorities"),
    ))
    passed = F.size(issues) == 0
    return {"hierarchy_passed": passed, "hierarchy_confidence": F.when(passed, 0.9).otherwise(0.6), "hierarchy_issues": issues}


# --- gates and routing ------------------------------------------------------


def retrieval_checks(hits: DataFrame) -> DataFrame:
    """Flags, warnings and the next step per query; hits(query_id, source, confidence, has_parent, chunk_id or null)."""
    per = hits.groupBy("query_id").agg(
        F.count("chunk_id").alias("n"), F.countDistinct(F.when(F.col("chunk_id").isNotNull(), F.col("source"))).alias("sources"),
        F.coalesce(F.max(F.col("has_parent").cast("int")), F.lit(0)).alias("parents"), F.max("retrieval_confidence").alias("confidence"),
    )
    has, sure, diverse = F.col("n") > 0, F.coalesce(F.col("confidence") >= 0.3, F.lit(False)), F.col("sources") > 1
    return per.select(
        "query_id", has.alias("has_results"), sure.alias("confidence_threshold"), diverse.alias("diverse_sources"),
        (F.col("parents") > 0).alias("has_parent_docs"),
        F.array_compact(F.array(
            F.when(~has, "No relevant documents found"), F.when(~sure, "Low retrieval confidence"),
            F.when(~diverse, "Results from single source only"),
        )).alias("warnings"),
        F.when(has & sure, "synthesize").otherwise("fallback").alias("next_step"),
    )


def synthesis_checks(answers: DataFrame) -> DataFrame:
    """answers(query_id, tldr, key_points, citations as arrays, confidence); a null tldr means no answer."""
    none = F.col("tldr").isNull()
    long, points, cited = F.length("tldr") >= 50, F.size("key_points") > 0, F.size("citations") > 0
    return answers.select(
        "query_id", (F.length(F.coalesce("tldr", F.lit(""))) > 0).alias("has_tldr"), F.coalesce(long, F.lit(False)).alias("tldr_length"),
        F.coalesce(points, F.lit(False)).alias("has_key_points"), F.coalesce(cited, F.lit(False)).alias("has_citations"),
        F.coalesce(F.col("confidence") >= 0.3, F.lit(False)).alias("confidence_acceptable"),
        F.when(none, F.array(F.lit("Synthesis quality check failed - no response"))).otherwise(F.array_compact(F.array(
            F.when(~long, "Response summary too short"), F.when(~points, "No key points generated"),
            F.when(~cited, "No citations provided"),
        ))).alias("warnings"),
    )


def refinement_step(passed, confidence, issues, complexity, iteration) -> Column:
    """pass, fail, retrieve_more or refine_synthesis, by the first rule that applies."""
    passed, conf, issues, level, i = _c(passed), _c(confidence), _c(issues), _c(complexity), _c(iteration)
    low = F.transform(issues, F.lower)

    def about(*words):
        return F.exists(low, lambda x: any_of(x, list(words)))

    coherence = about("coherence", "logic", "reasoning", "structure", "organization")
    sources = about("insufficient", "missing", "incomplete", "coverage", "source")
    return (
        F.when(conf.isNull(), "pass").when(i >= 2, "fail").when(passed & (conf > 0.8), "pass")
        .when(sources, "retrieve_more")
        .when((conf > 0.5) & (conf < 0.8) & coherence, "refine_synthesis")
        .when((level == "expert") & (conf < 0.7), "refine_synthesis")
        .when((conf >= 0.6) & (conf < 0.8) & (F.size(issues) > 0), "refine_synthesis")
        .otherwise("pass")
    )


def relevance_gate(contexts: DataFrame, recommended: DataFrame, min_sources: int = 2, min_ratio: float = 0.6) -> DataFrame:
    """Recommended sources per query and the gate; recommended(query_id, doc_key)."""
    marked = contexts.join(recommended.select("query_id", "doc_key", F.lit(1).alias("_r")).distinct(), ["query_id", "doc_key"], "left")
    per = marked.groupBy("query_id").agg(F.count("*").alias("before"), F.count("_r").alias("after"))
    ratio = F.col("after") / F.col("before")
    return per.select(
        "query_id", "before", "after", F.round(ratio, 6).alias("relevance_ratio"),
        ((F.col("after") >= min_sources) & (ratio >= min_ratio)).alias("passed"),
        F.array_compact(F.array(
            F.when(F.col("after") < min_sources, F.format_string("Insufficient relevant sources: %d < " + str(min_sources), "after")),
            F.when(ratio < min_ratio, F.format_string(f"Low relevance ratio: %.2f < {min_ratio}", F.bround(ratio, 2))),
        )).alias("issues"),
    )


def gate_rollup(checks: DataFrame) -> DataFrame:
    """checks(query_id, passed, issue) to all-passed, issue count and confidence."""
    n = F.count(F.when(~F.col("passed"), F.col("issue")))
    return checks.groupBy("query_id").agg(
        F.min(F.col("passed")).alias("passed"), n.alias("issues"),
        F.when(n > 0, F.greatest(F.lit(0.1), F.round(1.0 - n * 0.2, 6))).otherwise(1.0).alias("confidence"),
    )


def quality_score(density, grounded, reasoning, relevance_ratio, citations, answer_words) -> dict[str, Column]:
    """Four scores of 0-100, their weighted mean and a grade. A null density or reasoning scores 0."""
    density, grounded, reasoning, ratio, n, length = (_c(x) for x in (density, grounded, reasoning, relevance_ratio, citations, answer_words))
    base = density * 100
    coherence = F.lit(50)
    for name, value in COHERENCE_SCORES.items():
        coherence = F.when(reasoning == name, value).otherwise(coherence)
    parts = {
        "attribution": F.coalesce(F.round(F.when(grounded, F.least(F.lit(100.0), base + 20)).otherwise(base), 1), F.lit(0.0)),
        "coherence": F.when(reasoning.isNull(), 0.0).otherwise(coherence.cast("double")),
        "relevance": F.round(ratio * 100, 1),
        "citation_density": F.round(F.least(F.lit(100.0), n / F.greatest(F.lit(1.0), length / 100) * 50), 1),
    }
    # six digits first: the sum of a tie such as 45.35 may lie a last bit below it, and grades would miss their floor likewise
    overall = F.round(sum((parts[k] * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0)), 6)
    grade = F.lit("F")
    for floor, name in reversed(GRADES):
        grade = F.when(overall >= floor, name).otherwise(grade)
    return {**parts, "overall": F.round(overall, 1), "grade": grade}


def signup_fields(email: Column | str, source: Column | str, honeypot: Column | str | None = None) -> dict[str, Column]:
    """Normalized email and source, and whether the entry is acceptable or a bot's."""
    e = F.lower(strip(_c(email)))
    s = F.lower(strip(F.coalesce(_c(source), F.lit(""))))
    bot = F.lit(False) if honeypot is None else F.length(strip(F.coalesce(_c(honeypot), F.lit("")))) > 0
    ok = (F.length(e) <= 254) & e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z") & (F.length(s) <= 50)
    return {
        "email": e, "source": F.when(s.rlike(r"^[a-z0-9_-]+\z"), s).otherwise("web"),
        "is_bot": bot, "valid": F.coalesce(ok, F.lit(False)) & ~bot,
    }
