"""Query-log summaries, exact order statistics, latencies, experiments, sign-ups and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketlake.constants import DEFAULT_PRICE_MODEL, TOKEN_PRICES
from docketlake.session import materialize


def since(df: DataFrame, as_of: str, hours: int, ts: str = "ts") -> DataFrame:
    """Rows of the last hours before an explicit instant."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return df.where(F.col(ts) >= cutoff)


def log_row(df: DataFrame) -> DataFrame:
    """Bounded free text, as stored in the log."""
    out = df
    if "query_text" in df.columns:
        out = out.withColumn("query_text", F.substring("query_text", 1, 1000))
    if "comment" in df.columns:
        out = out.withColumn("comment", F.substring("comment", 1, 500))
    return out


def strip_internal(response: Column | str) -> Column:
    """Map without the keys that start with an underscore."""
    c = F.col(response) if isinstance(response, str) else response
    return F.map_filter(c, lambda k, _: ~k.startswith("_"))


def log_summary(log: DataFrame, keys: list[str] | None = None, approximate: bool = False) -> DataFrame:
    users = F.approx_count_distinct("user_id") if approximate else F.countDistinct("user_id")
    return log.groupBy(*(keys or [])).agg(
        F.count("*").alias("total_queries"),
        users.alias("unique_users"),
        F.coalesce(F.avg(F.coalesce("response_time_ms", F.lit(0.0))), F.lit(0.0)).alias("avg_response_time_ms"),
        F.coalesce(F.avg((F.col("status") == "success").cast("double")), F.lit(0.0)).alias("success_rate"),
    )


def top_topics(log: DataFrame, k: int = 10) -> DataFrame:
    good = log.where((F.col("status") == "success") & F.col("topic").isNotNull())
    return good.groupBy("topic").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "topic").limit(k)


def feedback_counts(feedback: DataFrame) -> DataFrame:
    def n(rating):
        return F.count(F.when(F.col("rating") == rating, 1))

    return feedback.agg(n(1).alias("positive"), n(0).alias("neutral"), n(-1).alias("negative"))


def unmatched_queries(log: DataFrame, k: int = 20) -> DataFrame:
    text = F.trim(F.lower("query_text"))
    missed = log.where(F.col("status").isin("no_match", "error")).select(text.alias("query")).where(F.length("query") > 3)
    return missed.groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(k)


# --- order statistics ------------------------------------------------------

#: Size of the quantile sketches (rank error well below MARGIN), and how far around a position exact values are kept.
SKETCH, MARGIN = 4000, 0.01


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, tuple[float, Column]]) -> DataFrame:
    """Exact values at given sorted positions per key, without ordering any key's values in one task.

    ``picks`` maps a column name to (fraction, position): the position is a 0-based Column over ``n``,
    the fraction says where to look. A mergeable quantile sketch per key bounds a narrow band around every position; values
    outside the bands collapse into counts. The rest is laid out by ranges of (key, value), so a key may span many
    partitions; each orders its own values, and the counts of the partitions before give it its start.
    """
    known = df.where(F.col(value).isNotNull())
    stats = known.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("_s"))
    ends = [F.lit(e) for fraction, _ in picks.values() for e in (max(fraction - MARGIN, 0.0), min(fraction + MARGIN, 1.0))]
    bounds = stats.select(*keys, F.array(*[F.kll_sketch_get_quantile_double("_s", e) for e in ends]).alias("_b"))
    placed = known.select(*keys, F.col(value).alias("_v")).join(bounds, keys)
    inside, below = F.lit(False), F.lit(None).cast("double")
    for i in range(len(picks)):
        lo, hi = F.get("_b", F.lit(2 * i)), F.get("_b", F.lit(2 * i + 1))
        inside = inside | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
        below = F.greatest(below, F.when(F.col("_v") > hi, hi.cast("double")))
    bucket = F.when(inside, F.col("_v").cast("double")).otherwise(F.coalesce(below, F.lit(float("-inf"))))
    counts = placed.groupBy(*keys, bucket.alias("_x")).agg(F.count("*").alias("_c"))
    ranged = materialize(counts.repartitionByRange(*keys, "_x").withColumn("_part", F.spark_partition_id()), "ordered-values")
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t"))  # a row per key and partition that has some of it
    before = F.sum("_t").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_t")
    within = F.sum("_c").over(W.partitionBy("_part", *keys).orderBy("_x"))
    running = ranged.withColumn("_upto", within).join(totals.select(*keys, "_part", before.alias("_base")), [*keys, "_part"])
    running = running.withColumn("_cum", F.col("_base") + F.col("_upto")).join(stats.select(*keys, "n"), keys)
    return running.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_cum") > position, F.col("_x"))).alias(name) for name, (_, position) in picks.items()]
    )


def at_fraction(fraction: float) -> tuple[float, Column]:
    """sorted(values)[int(fraction * n)]."""
    return fraction, F.floor(F.col("n") * F.lit(fraction))


def latency_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, avg, min, max and the exact p95 element per metric."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return base.join(order_statistics(df, keys, value, {"p95": at_fraction(0.95)}), keys)


def compare_cached(df: DataFrame, cached: str = "cached", value: str = "ms") -> DataFrame:
    """Mean, median, min and max with and without cache, the speed-up and the saving in per cent; one row."""
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    medians = order_statistics(df, [cached], value, {"_m1": (0.5, low), "_m2": (0.5, high)})
    side = df.groupBy(cached).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    ).join(medians, cached).withColumn("median", (F.col("_m1") + F.col("_m2")) / 2)

    def of(flag, name):
        return F.max(F.when(F.col(cached) == flag, F.col(name)))

    out = side.agg(*[
        of(flag, name).alias(f"{label}_{name}")
        for flag, label in ((True, "cached"), (False, "uncached"))
        for name in ("n", "mean", "median", "min", "max")
    ])
    return out.withColumn("speedup", F.col("uncached_mean") / F.col("cached_mean")).withColumn(
        "improvement_pct", (F.col("uncached_mean") - F.col("cached_mean")) / F.col("uncached_mean") * 100
    )


def throughput(jobs: DataFrame) -> DataFrame:
    """jobs(status, started, finished in seconds) to counts, duration and completed documents per hour."""
    done = F.count(F.when(F.col("status") == "completed", 1))
    span = F.max("finished") - F.min("started")
    return jobs.agg(
        F.count("*").alias("jobs"), done.alias("completed"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        span.alias("duration_s"),
        F.when(span > 0, done / (span / 3600.0)).otherwise(0.0).alias("docs_per_hour"),
    )


# --- experiments -----------------------------------------------------------


def variant_metrics(results: DataFrame, metrics: dict[str, Column] | None = None) -> DataFrame:
    """Sample size, mean latency, citations and grounding, and p95 latency per experiment and variant.

    ``metrics`` names further scores of a result, any Column over its columns (a pandas UDF around an evaluator fits as well);
    each gives avg_<name> over the results where it is not null and <name>_count, how many those are.
    """
    keys, metrics = ["experiment_id", "variant"], metrics or {}
    scored = results.withColumns({f"_m_{name}": score.cast("double") for name, score in metrics.items()}) if metrics else results
    base = scored.groupBy(*keys).agg(
        F.count("*").alias("sample_size"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg(F.coalesce("citation_count", F.lit(0))).alias("avg_citation_count"),
        F.avg(F.coalesce("grounding_score", F.lit(0.0))).alias("avg_grounding_score"),
        *[made for name in metrics for made in (F.avg(f"_m_{name}").alias(f"avg_{name}"), F.count(f"_m_{name}").alias(f"{name}_count"))],
    )
    return base.join(order_statistics(results, keys, "latency_ms", {"p95_latency_ms": at_fraction(0.95)}), keys)


def compare_variants(results: DataFrame, metric: str, control: str, min_samples: int = 30) -> DataFrame:
    """Every other variant against the control: relative improvement, significant above 5 per cent.

    Beside that rule, Welch's t of the two means and its degrees of freedom, from counts, means and variances alone; null where
    a variance cannot be told or both are 0.
    """
    observed = F.coalesce(metric, F.lit(0.0))
    means = results.groupBy("experiment_id", "variant").agg(
        F.count("*").alias("n"), F.avg(observed).alias("mean"), F.var_samp(observed).alias("var")
    )
    base = means.where(F.col("variant") == control).select("experiment_id", *[F.col(c).alias(f"control_{c}") for c in ("n", "mean", "var")])
    other = means.where(F.col("variant") != control)
    gain = F.when(F.col("control_mean") > 0, (F.col("mean") - F.col("control_mean")) / F.col("control_mean")).otherwise(0.0)
    enough = (F.col("n") >= min_samples) & (F.col("control_n") >= min_samples)
    own, ours = F.col("var") / F.col("n"), F.col("control_var") / F.col("control_n")
    error = F.when((F.col("n") > 1) & (F.col("control_n") > 1) & (own + ours > 0), own + ours)
    freedom = error * error / (own * own / (F.col("n") - 1) + ours * ours / (F.col("control_n") - 1))
    return other.join(base, "experiment_id").select(
        "experiment_id", "variant",
        (enough & (F.abs(gain) > 0.05)).alias("significant"),
        F.when(enough, F.round(gain * 100, 2)).alias("improvement"),
        F.round("control_mean", 3).alias("control_mean"), F.round("mean", 3).alias("treatment_mean"),
        F.when(enough, "medium").otherwise("Insufficient sample size").alias("confidence"),
        F.round((F.col("mean") - F.col("control_mean")) / F.sqrt(error), 6).alias("welch_t"), F.round(freedom, 4).alias("welch_df"),
    )


def recommendations(metrics: DataFrame) -> DataFrame:
    """Winner by grounding above 0.8, variants slower than 30 s, and too small samples, one row each."""
    winner = metrics.groupBy("experiment_id").agg(
        F.max(F.struct(F.col("avg_grounding_score").alias("score"), F.col("variant"))).alias("_w"),
        F.min("sample_size").alias("smallest"),
    )
    best = winner.where(F.col("_w.score") > 0.8).select(
        "experiment_id",
        F.format_string("Variant %s shows highest grounding score (%.2f)", "_w.variant", "_w.score").alias("recommendation"),
    )
    slow = metrics.where(F.col("avg_latency_ms") > 30000).select(
        "experiment_id",
        F.format_string("Variant %s has high latency (%.0fms) - consider optimization", "variant", "avg_latency_ms").alias("recommendation"),
    )
    small = winner.where(F.col("smallest") < 100).select(
        "experiment_id",
        F.format_string("Continue experiment - minimum sample size not reached (%d/100)", "smallest").alias("recommendation"),
    )
    return best.unionByName(slow).unionByName(small)


# --- sign-ups and costs ----------------------------------------------------


def waitlist_stats(entries: DataFrame, recent: int = 10, scope: str = "all") -> DataFrame:
    """Sign-ups per source with the total and the newest; scope="recent" counts sources in the newest entries only."""
    newest = entries.orderBy(F.desc("joined_at"), "email").limit(recent)
    counted = newest if scope == "recent" else entries
    total = entries.agg(F.count("*").alias("t"), F.max("joined_at").alias("m"))
    return counted.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("signups")).select(
        "source", "signups", total.select("t").scalar().alias("total_count"), total.select("m").scalar().alias("latest_signup")
    )


def token_cost(df: DataFrame, input_tokens: str = "input_tokens", output_tokens: str = "output_tokens", model: str = "model") -> DataFrame:
    """Price of every call; models without a price count at the default model's."""
    table = {m: (i, o) for m, i, o in TOKEN_PRICES}

    def price(position):
        out = F.lit(table[DEFAULT_PRICE_MODEL][position])
        for name, prices in table.items():
            out = F.when(F.col(model) == name, F.lit(prices[position])).otherwise(out)
        return out

    return df.withColumn("cost", F.col(input_tokens) / 1000 * price(0) + F.col(output_tokens) / 1000 * price(1))


def total_timing(timings: Column | str) -> Column:
    """Sum of a map of node timings."""
    c = F.col(timings) if isinstance(timings, str) else timings
    return F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def manifest_statistics(docs: DataFrame) -> DataFrame:
    """Document counts per type as text, jurisdictions, nodes and characters; one row."""
    per_type = docs.groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("tree_nodes_count", F.lit(0))).alias("nodes"),
        F.sum(F.coalesce("markdown_length", F.lit(0))).alias("chars"),
        F.collect_set(F.coalesce("jurisdiction", F.lit("unknown"))).alias("js"),
    )
    return per_type.agg(
        F.sum("n").alias("document_count"), F.sum("nodes").alias("total_tree_nodes"), F.sum("chars").alias("total_markdown_chars"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "doc_type", F.col("n").cast("string")))), ",").alias("doc_types"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("js")))), ",").alias("jurisdictions"),
    )
