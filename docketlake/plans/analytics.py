"""Query log, latency, experiment, sign-up, memory and cache queries over events and conversations."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from docketlake.functions import text as tx
from docketlake.functions.ids import assign_variant
from docketlake.operators import analytics as an, cache as ca, memory as me
from docketlake.plans.registry import query
from docketlake.plans.search import REQUEST_CTE, cache_requests, vector_index
from docketlake.plans.text import HALF, SHARES

AS_OF = "2024-01-31 00:00:00"

LOG_CTE = """log AS (SELECT event_id, ts, user_id, value * 100 AS response_time_ms, json_extract_string(props, '$.k') AS topic,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'no_match' ELSE 'success' END AS status,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 0 WHEN 'error' THEN -1 END AS rating,
    ' ' || upper(event_type) || ' ' || json_extract_string(props, '$.k') || ' ' AS query_text, event_type FROM events),
recent AS (SELECT * FROM log WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOURS)"""


def log(t):
    e = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    return t.events.select(
        "event_id", "ts", "user_id", (F.col("value") * 100).alias("response_time_ms"), k.alias("topic"),
        F.when(e == "error", "error").when(e == "view", "no_match").otherwise("success").alias("status"),
        F.when(e == "purchase", 1).when(e == "signup", 0).when(e == "error", -1).alias("rating"),
        F.concat(F.lit(" "), F.upper(e), F.lit(" "), k, F.lit(" ")).alias("query_text"), "event_type",
    )


def recent(t):
    return an.since(log(t), AS_OF, 168)


@query(
    "a1_log_summary",
    f"""WITH {LOG_CTE} SELECT count(*) AS total_queries, count(DISTINCT user_id) AS unique_users, round(avg(response_time_ms), 4) AS avg_response_time_ms,
    round(avg((status = 'success')::INTEGER), 6) AS success_rate FROM recent""",
)
def a1(t):
    s = an.log_summary(recent(t))
    return s.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 4)).withColumn("success_rate", F.round("success_rate", 6))


@query("a2_top_topics", f"WITH {LOG_CTE} SELECT topic, count(*) AS count FROM recent WHERE status = 'success' GROUP BY topic ORDER BY count DESC, topic LIMIT 10")
def a2(t):
    return an.top_topics(recent(t))


@query("a3_feedback", f"WITH {LOG_CTE} SELECT count(*) FILTER (rating = 1) AS positive, count(*) FILTER (rating = 0) AS neutral, count(*) FILTER (rating = -1) AS negative FROM recent")
def a3(t):
    return an.feedback_counts(recent(t))


@query(
    "a4_unmatched_queries",
    f"""WITH {LOG_CTE} SELECT trim(lower(query_text)) AS query, count(*) AS count FROM log WHERE status IN ('no_match', 'error')
    GROUP BY 1 HAVING length(trim(lower(query_text))) > 3 ORDER BY count DESC, query LIMIT 20""",
)
def a4(t):
    return an.unmatched_queries(log(t))


@query("t1_top_counts", f"WITH {LOG_CTE} SELECT user_id, count(*) AS n FROM log GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def t1(t):
    return log(t).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("p16_time_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOURS GROUP BY event_type")
def p16(t):
    return an.since(t.events, AS_OF, 24).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "p17_log_truncation",
    "SELECT doc_id, length(left(text, 1000)) AS query_chars, md5(left(text, 500)) AS comment_md5, 2 AS response_keys FROM documents",
)
def p17(t):
    d = t.documents.select("doc_id", F.col("text").alias("query_text"), F.col("text").alias("comment"),
                           F.create_map(F.lit("tldr"), F.col("lang"), F.lit("_cache_hit"), F.lit("x"), F.lit("source"), F.col("source")).alias("r"))
    return an.log_row(d).select(
        "doc_id", F.length("query_text").alias("query_chars"), F.md5("comment").alias("comment_md5"),
        F.size(an.strip_internal("r")).alias("response_keys"),
    )


@query(
    "a16_latency_summary",
    f"""WITH {LOG_CTE} SELECT event_type AS metric, count(*) AS count, round(avg(response_time_ms), 4) AS avg, min(response_time_ms) AS min, max(response_time_ms) AS max,
    (list(response_time_ms ORDER BY response_time_ms))[(floor(0.95 * count(*)) + 1)::BIGINT] AS p95 FROM log GROUP BY 1""",
)
def a16(t):
    s = an.latency_summary(log(t).withColumnRenamed("event_type", "metric"), ["metric"], "response_time_ms")
    return s.withColumn("avg", F.round("avg", 4))


@query(
    "a17_cached_latency",
    f"""WITH {LOG_CTE}, s AS (SELECT status = 'success' AS cached, response_time_ms AS ms FROM log),
    g AS (SELECT cached, count(*) AS n, avg(ms) AS mean, median(ms) AS median, min(ms) AS lo, max(ms) AS hi FROM s GROUP BY 1)
    SELECT c.n AS cached_n, round(c.mean, 4) AS cached_mean, round(c.median, 4) AS cached_median, c.lo AS cached_min, c.hi AS cached_max,
      u.n AS uncached_n, round(u.mean, 4) AS uncached_mean, round(u.median, 4) AS uncached_median, u.lo AS uncached_min, u.hi AS uncached_max,
      round(u.mean / c.mean, 6) AS speedup, round((u.mean - c.mean) / u.mean * 100, 4) AS improvement_pct FROM g c, g u WHERE c.cached AND NOT u.cached""",
)
def a17(t):
    r = an.compare_cached(log(t).select((F.col("status") == "success").alias("cached"), F.col("response_time_ms").alias("ms")))
    for c in ("cached_mean", "cached_median", "uncached_mean", "uncached_median", "improvement_pct"):
        r = r.withColumn(c, F.round(c, 4))
    return r.withColumn("speedup", F.round("speedup", 6))


@query(
    "a9_throughput",
    """SELECT count(*) AS jobs, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
    (max(epoch(o_orderdate)) - min(epoch(o_orderdate)))::BIGINT AS duration_s,
    round(count(*) FILTER (o_orderstatus = 'F') / ((max(epoch(o_orderdate)) - min(epoch(o_orderdate))) / 3600.0), 6) AS docs_per_hour FROM orders""",
)
def a9(t):
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    jobs = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"),
        at.alias("started"), at.alias("finished"),
    )
    return an.throughput(jobs).withColumn("docs_per_hour", F.round("docs_per_hour", 6))


RESULT_CTE = f"""res AS (SELECT event_type AS experiment_id, CASE WHEN ratio <= 0.5 THEN 'control' WHEN ratio <= 0.8 THEN 'treatment_a' ELSE 'treatment_b' END AS variant,
    value * 400 AS latency_ms, json_extract_string(props, '$.k')::INTEGER AS citation_count, least(value / 20, 1.0) AS grounding_score
  FROM (SELECT *, ((({HALF.format(1)}) * 1616 + ({HALF.format(17)})) % 10000)::DOUBLE / 10000.0 AS ratio FROM (SELECT *, user_id || ':exp1' AS u FROM events))),
vm AS (SELECT experiment_id, variant, count(*) AS n, avg(latency_ms) AS lat, avg(citation_count) AS cit, avg(grounding_score) AS gro,
    (list(latency_ms ORDER BY latency_ms))[(floor(0.95 * count(*)) + 1)::BIGINT] AS p95 FROM res GROUP BY ALL)"""


def results(t):
    return t.events.select(
        F.col("event_type").alias("experiment_id"), assign_variant("user_id", F.lit("exp1"), SHARES).alias("variant"),
        (F.col("value") * 400).alias("latency_ms"), F.get_json_object("props", "$.k").cast("int").alias("citation_count"),
        F.least(F.col("value") / 20, F.lit(1.0)).alias("grounding_score"),
    )


@query(
    "a18_variant_metrics",
    f"""WITH {RESULT_CTE} SELECT experiment_id, variant, n AS sample_size, round(lat, 4) AS avg_latency_ms, round(cit, 4) AS avg_citation_count,
    round(gro, 6) AS avg_grounding_score, p95 AS p95_latency_ms FROM vm""",
)
def a18(t):
    m = an.variant_metrics(results(t))
    return m.withColumns({
        "avg_latency_ms": F.round("avg_latency_ms", 4), "avg_citation_count": F.round("avg_citation_count", 4),
        "avg_grounding_score": F.round("avg_grounding_score", 6),
    })


@query(
    "d4_user_metrics",
    f"""WITH {RESULT_CTE} SELECT experiment_id, variant, round(avg(CASE WHEN citation_count > 2 THEN grounding_score END), 6) AS avg_cited_grounding,
    count(*) FILTER (citation_count > 2) AS cited_grounding_count, round(avg(latency_ms * latency_ms + 1), 4) AS avg_square, count(*) AS square_count FROM res GROUP BY ALL""",
)
def d4(t):
    """Two scores of the user: a Column, and an evaluator in Arrow batches."""

    @F.arrow_udf("double")
    def square(values: pa.Array) -> pa.Array:
        return pc.add(pc.multiply(values, values), 1.0)

    own = {"cited_grounding": F.when(F.col("citation_count") > 2, F.col("grounding_score")), "square": square("latency_ms")}
    m = an.variant_metrics(results(t), own)
    return m.select(
        "experiment_id", "variant", F.round("avg_cited_grounding", 6).alias("avg_cited_grounding"), "cited_grounding_count", F.round("avg_square", 4).alias("avg_square"), "square_count")


@query(
    "a19_variant_comparison",
    f"""WITH {RESULT_CTE}, x AS (SELECT v.experiment_id, v.variant, (v.gro - c.gro) / c.gro AS gain, v.n >= 30 AND c.n >= 30 AS enough, c.gro AS cm, v.gro AS tm
      FROM vm v JOIN vm c ON c.experiment_id = v.experiment_id AND c.variant = 'control' WHERE v.variant <> 'control')
    SELECT experiment_id, variant, enough AND abs(gain) > 0.05 AS significant, CASE WHEN enough THEN round(gain * 100, 2) ELSE 0 END AS improvement,
      round(cm, 3) AS control_mean, round(tm, 3) AS treatment_mean, CASE WHEN enough THEN 'medium' ELSE 'Insufficient sample size' END AS confidence FROM x""",
)
def a19(t):
    return an.compare_variants(results(t), "grounding_score", "control").withColumn(
        "improvement", F.coalesce("improvement", F.lit(0.0))
    ).drop("welch_t", "welch_df")


@query(
    "a19_welch",
    f"""WITH {RESULT_CTE}, m AS (SELECT experiment_id, variant, count(*) AS n, avg(coalesce(latency_ms, 0)) AS mean, var_samp(coalesce(latency_ms, 0)) AS var FROM res GROUP BY ALL),
    x AS (SELECT v.experiment_id, v.variant, v.n, c.n AS cn, v.mean - c.mean AS d, v.var / v.n AS a, c.var / c.n AS b FROM m v JOIN m c ON c.experiment_id = v.experiment_id AND c.variant = 'control' WHERE v.variant <> 'control')
    SELECT experiment_id, variant, round(d / sqrt(a + b), 6) AS welch_t, round((a + b) * (a + b) / (a * a / (n - 1) + b * b / (cn - 1)), 4) AS welch_df FROM x""",
)
def a19_welch(t):
    return an.compare_variants(results(t), "latency_ms", "control").select("experiment_id", "variant", "welch_t", "welch_df")


@query(
    "a20_recommendations",
    f"""WITH {RESULT_CTE}, w AS (SELECT experiment_id, max(gro) AS g, arg_max(variant, gro) AS v, min(n) AS smallest FROM vm GROUP BY 1)
    SELECT experiment_id, printf('Variant %s shows highest grounding score (%.2f)', v, g) AS recommendation FROM w WHERE g > 0.8
    UNION ALL SELECT experiment_id, printf('Variant %s has high latency (%.0fms) - consider optimization', variant, lat) FROM vm WHERE lat > 30000
    UNION ALL SELECT experiment_id, printf('Continue experiment - minimum sample size not reached (%d/100)', smallest) FROM w WHERE smallest < 100""",
)
def a20(t):
    return an.recommendations(an.variant_metrics(results(t)))


@query(
    "a21_waitlist_stats",
    """SELECT c_mktsegment AS source, count(*) AS signups, (SELECT count(*) FROM customer) AS total_count,
    (SELECT max(c_custkey) FROM customer) AS latest_signup FROM customer GROUP BY 1""",
)
def a21(t):
    entries = t.customer.select(F.col("c_name").alias("email"), F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("joined_at"))
    return an.waitlist_stats(entries)


@query(
    "a29_total_timing",
    "SELECT o_orderkey AS request_id, (o_custkey + floor(o_totalprice)::BIGINT + length(o_orderpriority))::BIGINT AS total_latency_ms FROM orders",
)
def a29(t):
    timings = F.create_map(
        F.lit("retrieve"), F.col("o_custkey"), F.lit("rerank"), F.floor("o_totalprice"), F.lit("check"), F.length("o_orderpriority").cast("long")
    )
    return t.orders.select(F.col("o_orderkey").alias("request_id"), an.total_timing(timings).alias("total_latency_ms"))


@query(
    "a30_token_cost",
    """SELECT model, count(*) AS calls, round(sum(i / 1000.0 * pi + o / 1000.0 * po), 6) AS cost FROM (SELECT lang AS l, CASE lang WHEN 'en' THEN 'gpt-5-mini' ELSE 'other' END AS model,
      n_chars // 4 AS i, n_chars // 8 AS o, CASE lang WHEN 'en' THEN 0.00015 ELSE 0.0015 END::DOUBLE AS pi, CASE lang WHEN 'en' THEN 0.0006 ELSE 0.002 END::DOUBLE AS po FROM documents) GROUP BY model""",
)
def a30(t):
    calls = t.documents.select(
        F.when(F.col("lang") == "en", "gpt-5-mini").otherwise("other").alias("model"),
        F.floor(F.col("n_chars") / 4).alias("input_tokens"), F.floor(F.col("n_chars") / 8).alias("output_tokens"),
    )
    return an.token_cost(calls).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


@query(
    "a8_manifest_statistics",
    """SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT sum(length(text) - length(replace(text, ' ', '')))::BIGINT FROM documents) AS total_tree_nodes,
    (SELECT sum(n_chars)::BIGINT FROM documents) AS total_markdown_chars,
    (SELECT string_agg(source || ':' || n, ',' ORDER BY source || ':' || n) FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)) AS doc_types,
    (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS jurisdictions""",
)
def a8(t):
    d = t.documents.select(
        F.col("source").alias("doc_type"), F.col("lang").alias("jurisdiction"), F.col("n_chars").alias("markdown_length"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("tree_nodes_count"),
    )
    return an.manifest_statistics(d)


# --- memory ----------------------------------------------------------------

MEMORY_CTE = """msgs AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations),
stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS recency FROM msgs) WHERE recency <= 10),
ctx AS (SELECT * FROM (SELECT *, length(content) // 4 AS tokens, (sum(length(content) // 4) OVER (PARTITION BY session_id ORDER BY recency))::BIGINT AS used FROM stored) WHERE used <= {0})"""


def messages(t):
    return t.conversations.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("w5_last_messages", f"WITH {MEMORY_CTE.format(500)} SELECT session_id, turn, recency FROM stored")
def w5(t):
    return me.last_messages(messages(t)).select("session_id", "turn", "recency")


@query("w6_recent_context", f"WITH {MEMORY_CTE.format(300)} SELECT session_id, turn, role, tokens, used FROM ctx")
def w6(t):
    return me.recent_context(messages(t), 300).select("session_id", "turn", "role", "tokens", "used")


@query(
    "w7_exchanges",
    f"""WITH {MEMORY_CTE.format(2000)}, n AS (SELECT *, sum((role = 'user')::INTEGER) OVER (PARTITION BY session_id ORDER BY turn) AS exchange FROM ctx WHERE role IN ('user', 'assistant')),
    p AS (SELECT session_id, exchange, max(content) FILTER (role = 'user') AS u, arg_max(content, turn) FILTER (role = 'assistant') AS a FROM n GROUP BY ALL)
    SELECT session_id, exchange::BIGINT AS exchange, md5(coalesce(u, '')) AS user_md5, md5(coalesce(a, '')) AS assistant_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY exchange DESC) AS r FROM p) WHERE r <= 3""",
)
def w7(t):
    e = me.exchanges(me.recent_context(messages(t), 2000))
    return e.select(
        "session_id", "exchange", F.md5(F.coalesce("user", F.lit(""))).alias("user_md5"),
        F.md5(F.coalesce("assistant", F.lit(""))).alias("assistant_md5"),
    )


PROFILE_CTE = """pl AS (SELECT event_id, ts, user_id, [event_type, 'topic' || (json_extract_string(props, '$.k')::INTEGER % 7)] AS areas,
    CASE WHEN value > 20 THEN 'complex' ELSE 'simple' END AS complexity, CASE WHEN value > 5 THEN 'professional' ELSE 'citizen' END AS user_type FROM events),
freq AS (SELECT user_id, areas[1] AS area, count(*) AS n FROM pl GROUP BY ALL),
prof AS (SELECT user_id, count(*) AS query_count, arg_max(complexity, struct_pack(ts := ts, e := event_id)) AS last_query_complexity,
    arg_max(user_type, struct_pack(ts := ts, e := event_id)) AS detected_user_type FROM pl GROUP BY 1)"""


def profile_log(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        "event_id", "ts", "user_id", F.array("event_type", F.concat(F.lit("topic"), (k % 7).cast("string"))).alias("areas"),
        F.when(F.col("value") > 20, "complex").otherwise("simple").alias("complexity"),
        F.when(F.col("value") > 5, "professional").otherwise("citizen").alias("user_type"),
    )


@query(
    "a25_profiles",
    f"""WITH {PROFILE_CTE} SELECT user_id, query_count, last_query_complexity, detected_user_type,
    (SELECT string_agg(area || '=' || n, ',' ORDER BY area) FROM freq f WHERE f.user_id = prof.user_id) AS area_frequency,
    (SELECT string_agg(DISTINCT a, ',' ORDER BY a) FROM (SELECT user_id, unnest(areas) AS a FROM pl) x WHERE x.user_id = prof.user_id) AS legal_interests FROM prof""",
)
def a25(t):
    p = me.profiles(profile_log(t))
    pairs = F.transform(F.map_entries("area_frequency"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return p.select(
        "user_id", "query_count", "last_query_complexity", "detected_user_type",
        F.array_join(F.array_sort(pairs), ",").alias("area_frequency"), F.array_join("legal_interests", ",").alias("legal_interests"),
    )


TOP_AREAS = "(SELECT string_agg(area, ',' ORDER BY n DESC, area) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, area) AS r FROM freq) f WHERE f.user_id = prof.user_id AND r <= 5)"


@query(
    "a26_personalization",
    f"WITH {PROFILE_CTE} SELECT user_id, {TOP_AREAS} AS top_areas, query_count, query_count > 5 AS is_returning_user FROM prof",
)
def a26(t):
    p = me.personalization(me.profiles(profile_log(t)))
    return p.select("user_id", F.array_join("top_legal_interests", ",").alias("top_areas"), "query_count", "is_returning_user")


@query(
    "w8_combined_memory",
    f"""WITH {MEMORY_CTE.format(350)}, {PROFILE_CTE}, lt AS (SELECT user_id, length('{{''expertise_level'': ''citizen'', ''typical_complexity'': ''moderate'', ''top_legal_interests'': ['''
      || replace({TOP_AREAS}, ',', ''', ''') || '''], ''query_count'': ' || query_count || ', ''is_returning_user'': ' || CASE WHEN query_count > 5 THEN 'True' ELSE 'False' END || '}}') // 4 AS long_term FROM prof),
    st AS (SELECT session_id, sum(tokens)::BIGINT AS short_term, count(*) AS messages FROM ctx GROUP BY 1)
    SELECT s.session_id, coalesce(short_term, 0) AS short_term, coalesce(long_term, 0) AS long_term, coalesce(messages, 0) AS messages,
      coalesce(short_term, 0) + coalesce(long_term, 0) AS total FROM (SELECT DISTINCT session_id FROM msgs) s LEFT JOIN st USING (session_id) LEFT JOIN lt ON lt.user_id = s.session_id""",
)
def w8(t):
    m = messages(t).withColumn("user_id", F.col("session_id"))
    return me.combined_memory(m, me.personalization(me.profiles(profile_log(t))), 500).drop("user_id")


# --- cache -----------------------------------------------------------------

CACHE_CTE = """entries AS (SELECT CASE WHEN user_id < 75 THEN 'citizen' ELSE 'professional' END AS user_type, lower(event_type) || ' ' || json_extract_string(props, '$.k') AS norm,
    max(struct_pack(ts := ts, id := event_id)).id AS response FROM events
    WHERE event_type IN ('purchase', 'view') AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-31 00:00:00' GROUP BY ALL)"""


@query(
    "j8_exact_cache",
    f"""WITH {CACHE_CTE} SELECT e.event_id AS query_id, md5(lower(e.event_type) || ' ' || json_extract_string(e.props, '$.k')) AS key, coalesce(c.response, -1) AS response
    FROM events e LEFT JOIN entries c ON c.norm = lower(e.event_type) || ' ' || json_extract_string(e.props, '$.k')
      AND c.user_type = CASE WHEN e.user_id < 75 THEN 'citizen' ELSE 'professional' END""",
)
def j8(t):
    kind = F.when(F.col("user_id") < 75, "citizen").otherwise("professional").alias("user_type")
    rows = log(t)
    cache = rows.where(F.col("event_type").isin("purchase", "view")).select(
        kind, tx.cache_key("query_text").alias("key"), F.col("event_id").alias("response"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
    )
    req = rows.select(F.col("event_id").alias("query_id"), kind, F.col("query_text").alias("query"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return ca.exact_lookup(req, cache, as_of=as_of).select("query_id", "key", F.coalesce("response", F.lit(-1)).alias("response"))


TWO_LEVEL_CTE = f"""{REQUEST_CTE},
keyed AS (SELECT vec_id, label, floor(embedding[1]::DOUBLE * 50)::BIGINT::VARCHAR AS key, floor(embedding[2]::DOUBLE * 50)::BIGINT::VARCHAR AS asked FROM embeddings),
firsts AS (SELECT label, key, min(vec_id) AS exact_id FROM keyed GROUP BY ALL),
lookups AS (SELECT k.vec_id AS query_id, coalesce(f.exact_id, s.item_id, -1) AS item_id,
    CASE WHEN f.exact_id IS NOT NULL THEN 'exact' WHEN s.item_id IS NOT NULL THEN 'semantic' ELSE 'miss' END AS hit_type
  FROM keyed k LEFT JOIN firsts f ON f.label = k.label AND f.key = k.asked LEFT JOIN (SELECT s.* FROM
    (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM pairs) s WHERE r = 1 AND score >= 0.9) s ON s.query_id = k.vec_id)"""


def lookups(t):
    def key(dim):
        return F.floor(F.get("embedding", F.lit(dim)).cast("double") * 50).cast("string").alias("key")

    cache = vector_index(t).withColumn("key", key(0)).withColumnRenamed("label", "user_type")
    keys = t.embeddings.select(F.col("vec_id").alias("query_id"), key(1))
    req = cache_requests(t).join(keys, "query_id").withColumnRenamed("label", "user_type")
    return ca.two_level_lookup(req, cache, 0.9, cells=16)


@query("j10_two_level_cache", f"WITH {TWO_LEVEL_CTE} SELECT query_id, item_id, hit_type FROM lookups")
def j10(t):
    return lookups(t).select("query_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"), "hit_type")


@query(
    "a22_cache_statistics",
    f"""WITH {TWO_LEVEL_CTE} SELECT count(*) AS total_requests, count(*) FILTER (hit_type = 'exact') AS exact_hits, count(*) FILTER (hit_type = 'semantic') AS semantic_hits,
    count(*) FILTER (hit_type = 'miss') AS misses, round(avg((hit_type <> 'miss')::INTEGER), 6) AS hit_rate FROM lookups""",
)
def a22(t):
    return ca.cache_statistics(lookups(t)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "x4_live_cache",
    """SELECT event_id, ttl_s, floor(epoch(ts + to_seconds(ttl_s)))::BIGINT AS expires FROM (SELECT event_id, ts, CASE WHEN value > 20 THEN 1800 ELSE 7200 END AS ttl_s FROM events)
    WHERE ts + to_seconds(ttl_s) > TIMESTAMP '2024-01-15 12:00:00'""",
)
def x4(t):
    rows = t.events.select(
        "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("query"),
        F.when(F.col("value") > 20, "complex").otherwise("simple").alias("complexity"),
        F.create_map(F.lit("tldr"), F.col("props"), F.lit("_hit"), F.lit("x")).alias("response"),
    )
    cache = ca.live(ca.cache_rows(rows), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return cache.select("event_id", "ttl_s", F.unix_timestamp(F.col("expires_at").cast("timestamp")).alias("expires"))
