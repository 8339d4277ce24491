"""Time-dependent operators in their batch form over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.plans.analytics import LOG_CTE, log
from docketlake.plans.registry import query
from docketlake.session import scratch
from docketlake.sources.corpus import append_new, read_keyed
from docketlake.streaming import limits as li, state as st, summaries as su


def limit_oracle(limits, ban=0, flagged="FALSE"):
    horizon = max(s for _, s in limits)
    checks = " ".join(
        f"WHEN len(list_filter(acc, lambda x: now - x < {s})) >= {n} THEN {{'s': 'limited', 'r': floor({s} - (now - list_filter(acc, lambda x: now - x < {s})[1]))::INTEGER + 1}}"
        for n, s in limits
    )
    return f"""WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch(ts) AS now, {flagged} AS flagged, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    fold AS (SELECT 0::BIGINT AS event_id, user_id, 0::BIGINT AS i, []::DOUBLE[] AS acc, 0::DOUBLE AS ban, {{'s': '', 'r': 0}} AS d FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT event_id, user_id, i, CASE WHEN d.s IN ('admitted', 'bot') THEN list_append(acc, now) ELSE acc END, CASE WHEN d.s = 'bot' THEN now + {ban} ELSE ban END, d
      FROM (SELECT e.event_id, e.user_id, e.i, e.now, list_filter(f.acc, lambda x: e.now - x < {horizon}) AS acc, f.ban,
        CASE WHEN now < f.ban THEN {{'s': 'banned', 'r': floor(f.ban - now)::INTEGER + 1}} {checks.replace('acc,', 'f.acc,')} WHEN flagged THEN {{'s': 'bot', 'r': {ban}}} ELSE {{'s': 'admitted', 'r': 0}} END AS d
        FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1))
    SELECT event_id AS request_id, user_id AS client, d.s AS status, d.r AS retry_after FROM fold WHERE i > 0"""


def requests(t, flagged=None):
    return t.events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts", (F.lit(False) if flagged is None else flagged).alias("flagged"))


RESULT = ["request_id", "client", "status", "retry_after"]


@query("x1_rate_limit", limit_oracle([(3, 86400)]))
def x1(t):
    return li.limit_requests(requests(t), [(3, 86400)], ban_seconds=0).select(*RESULT)


@query("x2_two_level_limit", limit_oracle([(2, 43200), (5, 432000)]))
def x2(t):
    return li.limit_requests(requests(t), [(2, 43200), (5, 432000)], ban_seconds=0).select(*RESULT)


@query("x3_honeypot_bans", limit_oracle([(3, 86400)], 172800, "event_type = 'error'"))
def x3(t):
    return li.limit_requests(requests(t, F.col("event_type") == "error"), [(3, 86400)], ban_seconds=172800).select(*RESULT)


@query("x5_recent_log", f"WITH {LOG_CTE} SELECT event_id, user_id FROM log ORDER BY ts DESC, event_id DESC LIMIT 1000")
def x5(t):
    return log(t).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "user_id")


@query(
    "x6_rolling_summary",
    f"""WITH {LOG_CTE}, w AS (SELECT log.*, unnest(generate_series(0, 3)) AS k FROM log), s AS (SELECT *, (floor(epoch(ts) / 21600)::BIGINT - k) * 21600 AS start FROM w)
    SELECT start, count(*) AS total_queries, count(DISTINCT user_id) AS unique_users, round(avg(response_time_ms), 4) AS avg_response_time_ms, round(avg((status = 'success')::INTEGER), 6) AS success_rate,
    count(*) FILTER (rating = 1) AS positive, count(*) FILTER (rating = 0) AS neutral, count(*) FILTER (rating = -1) AS negative FROM s GROUP BY start""",
)
def x6(t):
    r = su.rolling_summary(log(t), "24 hours", "6 hours")
    return r.select(
        F.unix_timestamp(F.col("window_start").cast("timestamp")).alias("start"), "total_queries", "unique_users",
        F.round("avg_response_time_ms", 4).alias("avg_response_time_ms"), F.round("success_rate", 6).alias("success_rate"), "positive", "neutral", "negative")


@query("x7_first_signups", "SELECT user_id AS email, event_id AS waitlist_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'signup') WHERE r = 1")
def x7(t):
    rows = t.events.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("email"), F.col("event_id").alias("waitlist_id"), F.col("ts").alias("joined_at"))
    return st.earliest(rows).select("email", "waitlist_id")


@query("x8_profile_counters", "SELECT user_id, count(*) AS query_count, arg_max(event_type, ts) AS last_query_complexity, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS legal_interests FROM events GROUP BY 1")
def x8(t):
    rows = t.events.select("user_id", "ts", F.col("event_type").alias("area"), F.col("event_type").alias("complexity"), F.lit("citizen").alias("user_type"))
    return su.profile_counters(rows).select("user_id", "query_count", "last_query_complexity", F.array_join("legal_interests", ",").alias("legal_interests"))


@query(
    "x9_sessions",
    """WITH g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 1e9) >= 43200)::INTEGER AS n FROM events))
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS messages FROM g GROUP BY user_id, s""",
)
def x9(t):
    s = su.sessions(t.events, gap="12 hours")
    return s.select("user_id", F.unix_timestamp(F.col("session_start").cast("timestamp")).alias("session_start"), "messages")


@query("x10_ingest_new", "SELECT doc_id, lang, source, doc_id IN (SELECT doc_id FROM labels) AS first_batch FROM documents")
def x10(t):
    """Two arrivals of documents, the second repeating the first: nothing is stored twice."""
    path = scratch(t.spark, "ingest")
    docs = t.documents.select("doc_id", "lang", "source")
    known = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi").withColumn("first_batch", F.lit(True))
    append_new(known, path, "doc_id")
    append_new(docs.withColumn("first_batch", F.lit(False)), path, "doc_id")
    return read_keyed(t.spark, path)
