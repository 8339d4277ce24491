"""Scalar text, identifier and query-understanding functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions import ids, query as fq, text as tx
from docketlake.operators.fusion import complexity_value
from docketlake.operators.retrieval import query_variants
from docketlake.plans.common import sql_any, sql_collapse, sql_normalize, sql_strip, sql_tokens, sql_words
from docketlake.plans.registry import query


@query(
    "f1_token_estimates",
    f"""SELECT doc_id, length(text) // 4 AS by_chars, round(len({sql_words('text')}) * 1.3::DOUBLE, 4) AS by_words,
    floor(len({sql_words('text')}) / 0.75)::BIGINT AS by_ratio FROM documents""",
)
def f1(t):
    return t.dealt("documents", "doc_id").select(
        "doc_id",
        tx.estimate_tokens("text").alias("by_chars"),
        F.round(tx.estimate_tokens("text", "words"), 4).alias("by_words"),
        tx.estimate_tokens("text", "ratio").alias("by_ratio"),
    )


@query("f2_normalize_text", f"SELECT doc_id, md5({sql_normalize('text')}) AS text_md5 FROM documents")
def f2(t):
    return t.dealt("documents", "doc_id").select("doc_id", F.md5(tx.normalize_text("text")).alias("text_md5"))


NORM_Q = sql_strip(rf"regexp_replace({sql_collapse(sql_strip('lower(text)'))}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}\-.]', ' ', 'g')")


@query(
    "f3_normalize_query",
    f"SELECT conv_id, turn, md5({NORM_Q}) AS normalized_md5, md5({sql_strip(sql_collapse('lower(text)'))}) AS cache_key FROM conversations",
)
def f3(t):
    return t.conversations.select(
        "conv_id", "turn", F.md5(tx.normalize_query("text")).alias("normalized_md5"), tx.cache_key("text").alias("cache_key")
    )


@query(
    "f4_legal_tokens",
    f"""SELECT doc_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_terms, len(ts[1:200]) AS n_capped, md5(array_to_string(ts, ' ')) AS tokens_md5
    FROM (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)""",
)
def f4(t):
    d = t.dealt("documents", "doc_id").select("doc_id", tx.legal_tokens("text").alias("ts"))
    return d.select(
        "doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_terms"),
        F.size(F.slice("ts", 1, 200)).alias("n_capped"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"),
    )


@query(
    "f5_keywords",
    rf"""SELECT item_id, array_to_string(list_slice(ws, 1, 20), ' ') AS leading, len(ws) AS n_words
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{3,}}') AS ws FROM benchmark)""",
)
def f5(t):
    return t.benchmark.select(
        "item_id", F.array_join(tx.keywords("text"), " ").alias("leading"), F.size(tx.keywords("text", None)).alias("n_words")
    )


@query(
    "f7_document_ids",
    f"""SELECT doc_id, substr(sha256(source || '/' || doc_id), 1, 16) AS document_id, substr(sha1(text), 1, 8) AS text_sha1,
    substr(sha256(concat_ws('_', doc_id, 0, left(text, 100))), 1, 16) AS sub_id FROM documents""",
)
def f7(t):
    return t.documents.select(
        "doc_id",
        ids.document_id(F.concat_ws("/", "source", "doc_id")).alias("document_id"),
        F.substring(F.sha1("text"), 1, 8).alias("text_sha1"),
        ids.sub_chunk_id(F.col("doc_id").cast("string"), F.lit(0), "text").alias("sub_id"),
    )


SECRET = "a-fixed-test-key"
PAD_IN = "".join(f"{b ^ 0x36:02x}" for b in SECRET.encode().ljust(64, b"\0"))
PAD_OUT = "".join(f"{b ^ 0x5C:02x}" for b in SECRET.encode().ljust(64, b"\0"))


@query(
    "f8_pseudonyms",
    f"""SELECT user_id, count(*) AS n, substr(sha256(unhex('{PAD_OUT}') || unhex(sha256(unhex('{PAD_IN}') || encode(user_id::VARCHAR)))), 1, 16) AS user_hash
    FROM events GROUP BY user_id""",
)
def f8(t):
    users = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return users.withColumn("user_hash", ids.pseudonym("user_id", SECRET))


SHARES = [("control", 0.5), ("treatment_a", 0.3), ("treatment_b", 0.2)]
HALF = "('0x' || substr(md5(u), {0}, 16))::UBIGINT::HUGEINT % 10000"
VARIANT_SQL = f"""SELECT user_id, ratio, CASE WHEN ratio <= 0.5 THEN 'control' WHEN ratio <= 0.8 THEN 'treatment_a' ELSE 'treatment_b' END AS variant
    FROM (SELECT user_id, ((({HALF.format(1)}) * 1616 + ({HALF.format(17)})) % 10000)::DOUBLE / 10000.0 AS ratio
      FROM (SELECT DISTINCT user_id, user_id || ':exp1' AS u FROM events))"""


@query("f9_variant_assignment", VARIANT_SQL)
def f9(t):
    return t.events.select("user_id").distinct().select(
        "user_id",
        ids.assignment_ratio("user_id", F.lit("exp1")).alias("ratio"),
        ids.assign_variant("user_id", F.lit("exp1"), SHARES).alias("variant"),
    )


@query(
    "f36_safe_names",
    rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '^/', ''), '[^A-Za-z0-9._-]', '_', 'g') || '.pdf' AS pdf_name,
    CASE WHEN s = '' THEN 'unknown' WHEN length(s) > 80 THEN rtrim(left(s, 80), '_') ELSE s END AS slug,
    regexp_replace(translate(title, '“”‘’—–', '""''''--'), '[^\x00-\x7F]', '', 'g') AS ascii_title
    FROM (SELECT page_id, url, title, lower(trim(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS s
      FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))""",
)
def f36(t):
    p = t.pages.withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select(
        "page_id", tx.safe_pdf_name("url").alias("pdf_name"), tx.slug("title").alias("slug"), tx.ascii_only("title").alias("ascii_title")
    )


@query(
    "f38_rule_title",
    rf"""SELECT doc_id, coalesce(list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 20), lambda x: {sql_strip('x')}),
      lambda x: regexp_matches(x, '(?i)^(Supreme Court Rules|High Court Rules|[A-Z][A-Za-z\s]+Rules|Statutory Instrument|[A-Z][A-Za-z\s]+Act)'))[1], 'none') AS title FROM documents""",
)
def f38(t):
    return t.dealt("documents", "doc_id").select("doc_id", tx.rule_title("text", "none").alias("title"))


@query("f39_answer_tokens", """SELECT query_id, CASE complexity WHEN 'simple' THEN 800 WHEN 'moderate' THEN 2500 WHEN 'complex' THEN 5000 WHEN 'expert' THEN 8000 ELSE 2500 END AS answer_tokens,
    CASE complexity WHEN 'simple' THEN 7200 WHEN 'moderate' THEN 3600 WHEN 'complex' THEN 1800 WHEN 'expert' THEN 900 ELSE 3600 END AS ttl
    FROM (SELECT o_orderkey AS query_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'simple' WHEN '2-HIGH' THEN 'moderate' WHEN '3-MEDIUM' THEN 'complex'
      WHEN '5-LOW' THEN 'expert' ELSE 'other' END AS complexity FROM orders)""")
def f39(t):
    p = F.col("o_orderpriority")
    level = (
        F.when(p == "1-URGENT", "simple").when(p == "2-HIGH", "moderate").when(p == "3-MEDIUM", "complex")
        .when(p == "5-LOW", "expert").otherwise("other")
    )
    return t.dealt("orders", "o_orderkey").select(
        F.col("o_orderkey").alias("query_id"),
        complexity_value("answer_tokens", level).alias("answer_tokens"), complexity_value("ttl", level).alias("ttl"),
    )


# --- questions made from orders ---------------------------------------------

QUESTION_SQL = """qs AS (SELECT o_orderkey AS query_id, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'What does section ' || o_custkey || 'a of  the Act [Chapter 28:' || lpad((o_custkey % 100)::VARCHAR, 2, '0') || '] say as at 2023/01/' || lpad((o_custkey % 28 + 1)::VARCHAR, 2, '0') || '?'
    WHEN '2-HIGH' THEN 'My rights and the Constitution of Zimbabwe, order ' || o_custkey
    WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'O' THEN 'How to file papers in court' WHEN 'F' THEN 'hello, customer ' || o_custkey ELSE 'Is a precedent binding? S. ' || o_custkey || ' v. State' END
    WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'O' THEN 'tax or wage duty, compare si ' || o_custkey ELSE 'labour law and salary; penalty for breach of contract' END
    ELSE CASE o_orderstatus WHEN 'O' THEN 'What about it, summary please' WHEN 'F' THEN 'number ' || o_custkey || ' s 12C chapter 7:11' ELSE 'unclear status ' || o_custkey END END AS query FROM orders)"""


def questions(t):
    key = F.col("o_custkey").cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    text = (
        F.when(priority == "1-URGENT", F.concat(
            F.lit("What does section "), key, F.lit("a of  the Act [Chapter 28:"), two(F.col("o_custkey") % 100),
            F.lit("] say as at 2023/01/"), two(F.col("o_custkey") % 28 + 1), F.lit("?")))
        .when(priority == "2-HIGH", F.concat(F.lit("My rights and the Constitution of Zimbabwe, order "), key))
        .when(priority == "3-MEDIUM", F.when(status == "O", "How to file papers in court")
              .when(status == "F", F.concat(F.lit("hello, customer "), key))
              .otherwise(F.concat(F.lit("Is a precedent binding? S. "), key, F.lit(" v. State"))))
        .when(priority == "4-NOT SPECIFIED", F.when(status == "O", F.concat(F.lit("tax or wage duty, compare si "), key))
              .otherwise("labour law and salary; penalty for breach of contract"))
        .otherwise(F.when(status == "O", "What about it, summary please")
                   .when(status == "F", F.concat(F.lit("number "), key, F.lit(" s 12C chapter 7:11")))
                   .otherwise(F.concat(F.lit("unclear status "), key)))
    )
    return t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("query_id"), text.alias("query"), "o_orderstatus")


DATE_RE = r"(?i)\b(?:as\s+(?:at|of)|on|before|after)\s+(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"
NQ = sql_strip(rf"regexp_replace({sql_collapse(sql_strip('lower(query)'))}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}\-.]', ' ', 'g')")


def sql_section(c):
    parts = [f"nullif(regexp_extract({c}, '(?i)\\b{p}([0-9]+[A-Za-z]?)\\b', 1), '')" for p in (r"section\s+", r"s\.?\s*", r"sec\.?\s*")]
    return f"upper(coalesce({', '.join(parts)}))"


def sql_chapter(c):
    return f"nullif(regexp_extract({c}, '(?i)\\bchapter\\s*([0-9]{{1,3}}:[0-9]{{2}})\\b', 1), '')"


@query(
    "f23_query_context",
    f"""WITH {QUESTION_SQL}, x AS (SELECT query_id, query, regexp_extract(query, '{DATE_RE}', 1) AS d, {NQ} AS n FROM qs)
    SELECT query_id, CASE WHEN d <> '' THEN {sql_collapse(sql_strip(f"regexp_replace(query, '{DATE_RE}', '', 'g')"))} ELSE query END AS clean_query,
      coalesce(replace(d, '/', '-'), '') AS as_of, coalesce({sql_section('query')}, '') AS section, coalesce({sql_chapter('query')}, '') AS chapter,
      {sql_section('n')} IS NOT NULL AND {sql_chapter('n')} IS NOT NULL AS section_lookup, {sql_section('n')} IS NULL AS general_question FROM x""",
)
def f23(t):
    q = questions(t).select(
        "query_id", fq.date_context("query").alias("d"), fq.section_of("query").alias("s"), fq.chapter_of("query").alias("c"),
        fq.intent_flags("query").alias("i"),
    )
    return q.select(
        "query_id", F.col("d.clean_query").alias("clean_query"), F.coalesce("d.date", F.lit("")).alias("as_of"),
        F.coalesce("s", F.lit("")).alias("section"), F.coalesce("c", F.lit("")).alias("chapter"),
        F.col("i.section_lookup").alias("section_lookup"), F.col("i.general_question").alias("general_question"),
    )


def sql_count(c, parts):
    return "(" + " + ".join(f"contains({c}, '{p}')::INTEGER" for p in parts) + ")"


def sql_area(c, table):
    return "CASE " + " ".join(f"WHEN {sql_any(c, p)} THEN '{n}'" for n, p in table) + " ELSE 'general' END"


INTENT_CTE = rf"""{QUESTION_SQL},
f AS (SELECT query_id, query, lower(trim(query)) AS q, len({sql_words('query')}) AS n FROM qs),
g AS (SELECT *, regexp_matches(q, '\b({'|'.join(fq.GREETINGS)})\b') AS hi, ({' OR '.join(f"regexp_matches(q, '{p}')" for p in fq.PROFESSIONAL_SIGNS)}) AS pro,
  {sql_any('q', fq.STATUTE_CONNECTIVES)} AS several, {sql_any('q', fq.GENERAL_CONNECTIVES)} AS joined, {sql_count('q', fq.LEGAL_WORDS)} AS legal FROM f),
h AS (SELECT *, CASE WHEN hi THEN 1 WHEN {sql_any('q', fq.SUMMARY_PHRASES)} THEN 2 WHEN {sql_any('q', fq.CONSTITUTION_WORDS)} THEN 3
  WHEN regexp_matches(q, '{fq.STATUTE_PATTERN}') THEN 4 WHEN {sql_any('q', fq.PROCEDURE_WORDS)} THEN 5 WHEN {sql_any('q', fq.CASE_WORDS)} THEN 6
  WHEN {sql_any('q', fq.RIGHTS_WORDS)} THEN 7 WHEN {sql_any('q', fq.UNCLEAR_WORDS)} THEN 8 WHEN legal > 0 THEN 9 ELSE 0 END AS rule FROM g),
intents AS (SELECT query_id, rule,
  CASE WHEN rule = 1 THEN 'conversational' WHEN rule = 2 THEN 'summarize' WHEN rule = 8 THEN 'disambiguate' WHEN rule = 0 THEN 'none' ELSE 'rag_qa' END AS intent,
  CASE WHEN rule IN (1, 2, 5, 7, 8) THEN 'simple' WHEN rule IN (3, 6) THEN 'complex'
    WHEN rule = 4 THEN CASE WHEN n >= 25 OR several OR pro THEN 'complex' ELSE 'moderate' END
    WHEN rule = 9 THEN CASE WHEN n >= 25 OR (joined AND legal >= 3) THEN 'complex' WHEN n > 15 OR legal >= 2 THEN 'moderate' ELSE 'simple' END ELSE '' END AS complexity,
  CASE WHEN rule = 0 THEN '' WHEN rule IN (1, 7) OR NOT pro THEN 'citizen' ELSE 'professional' END AS user_type,
  [0.0, 0.95, 0.9, 0.9, 0.85, 0.8, 0.85, 0.85, 0.8, 0.7][rule + 1]::DOUBLE AS confidence,
  CASE rule WHEN 3 THEN 'constitutional_law' WHEN 4 THEN {sql_area('q', fq.STATUTE_AREAS)} WHEN 5 THEN 'procedure' WHEN 6 THEN 'case_law'
    WHEN 7 THEN 'general' WHEN 8 THEN 'general' WHEN 9 THEN {sql_area('q', fq.GENERAL_AREAS)} ELSE '' END AS area FROM h)"""


def intents(t):
    return fq.classify_intents(questions(t)).select(
        "query_id",
        F.coalesce("intent", F.lit("none")).alias("intent"), F.coalesce("complexity", F.lit("")).alias("complexity"),
        F.coalesce("user_type", F.lit("")).alias("user_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("area", F.lit("")).alias("area"),
    )


@query("f24_intent_classes", f"WITH {INTENT_CTE} SELECT query_id, intent, complexity, user_type, confidence, area FROM intents")
def f24(t):
    return intents(t)


@query(
    "a34_heuristic_coverage",
    f"""WITH {INTENT_CTE} SELECT intent, count(*) AS n, round(avg((confidence >= 0.8)::INTEGER), 6) AS confident_share, round(avg((rule = 0)::INTEGER), 6) AS fallback_share
    FROM intents GROUP BY intent""",
)
def a34(t):
    return intents(t).groupBy("intent").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("confidence") >= 0.8).cast("int")), 6).alias("confident_share"),
        F.round(F.avg((F.col("intent") == "none").cast("int")), 6).alias("fallback_share"),
    )


@query(
    "f25_follow_ups",
    rf"""SELECT conv_id, turn, {' OR '.join(f"regexp_matches(lower(text), '{p}')" for p in fq.FOLLOW_UP_PATTERNS if 'it|that' not in p)}
      OR regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])(it|that|this|those|these)($|[^\p{{L}}\p{{N}}_])') AS follow_up,
    {sql_any('lower(text)', fq.DECOMPOSITION_WORDS)} AS decompose, CASE WHEN {sql_any('lower(text)', fq.JURISDICTION_WORDS)} THEN 'ZW' ELSE '' END AS jurisdiction
    FROM conversations""",
)
def f25(t):
    return t.conversations.select(
        "conv_id", "turn", fq.is_follow_up("text").alias("follow_up"), fq.needs_decomposition("text").alias("decompose"),
        F.coalesce(fq.jurisdiction_of("text"), F.lit("")).alias("jurisdiction"),
    )


VARIANT_LIST = rf"""list_slice(list_filter([n,
    CASE WHEN contains(' ' || n || ' ', ' si ') THEN replace(n, ' si ', ' statutory instrument ') END,
    CASE WHEN s IS NOT NULL THEN CASE WHEN sp <> n THEN sp END END,
    CASE WHEN c IS NOT NULL AND NOT contains(n, c) THEN n || ' chapter ' || c END],
    lambda v: v IS NOT NULL AND v <> ''), 1, 4)"""
REFORM_CTE = rf"""{QUESTION_SQL}, b AS (SELECT query_id, {NQ} AS n FROM qs),
    p AS (SELECT *, {sql_section('n')} AS s, {sql_chapter('n')} AS c, regexp_replace(n, '(?i)\bs\.?\s*(\d+[A-Za-z]?)', 'section \1', 'g') AS sp FROM b),
    v AS (SELECT query_id, {VARIANT_LIST} AS vs FROM p)"""


@query("f26_reformulations", f"WITH {REFORM_CTE} SELECT query_id, array_to_string(vs, '|') AS variants FROM v")
def f26(t):
    return questions(t).select("query_id", F.array_join(fq.reformulations("query"), "|").alias("variants"))


@query(
    "j15_query_variants",
    f"WITH {REFORM_CTE} SELECT query_id, (generate_subscripts(vs, 1) - 1)::BIGINT AS variant_idx, unnest(vs) AS variant FROM v",
)
def j15(t):
    return query_variants(questions(t))


@query(
    "u4_distinct_variants",
    f"""WITH w AS (SELECT item_id, list_transform({sql_words('text')}, lambda x: lower(x)) AS ws FROM benchmark)
    SELECT item_id, array_to_string(list_slice(list_filter(ws, lambda x, i: list_position(ws, x) = i), 1, 12), ' ') AS variants FROM w""",
)
def u4(t):
    return t.benchmark.select(
        "item_id", F.array_join(fq.distinct_capped(F.transform(tx.words("text"), F.lower), 12), " ").alias("variants")
    )


@query(
    "f27_rewrites",
    f"""WITH {QUESTION_SQL}, l AS (SELECT q.query_id, query, lower(query) AS q, o_orderstatus AS st FROM qs q JOIN orders ON o_orderkey = query_id)
    SELECT query_id, query || CASE WHEN contains(q, 'tax') THEN '' ELSE ' (user context: tax)' END
      || CASE WHEN contains(q, 'rights') OR contains(q, 'constitution') THEN ' constitutional law Zimbabwe fundamental rights'
        WHEN contains(q, 'act') OR contains(q, 'law') THEN ' Zimbabwe legislation statutory provisions' ELSE '' END
      || CASE WHEN contains(q, 'zimbabwe') OR contains(q, 'zw') OR contains(q, 'harare') THEN ' [Jurisdiction: ZW]' ELSE '' END AS rewritten,
    CASE st WHEN 'O' THEN query || ' company law' WHEN 'F' THEN query || ' constitutional law' ELSE query END AS variant,
    query || CASE st WHEN 'O' THEN ' - specifically focusing on legal citations and statutory references, comprehensive coverage including case law and judicial precedents'
      WHEN 'F' THEN ' - specifically focusing on case law precedents including statutory provisions and regulations' ELSE ' - additional legal sources and authorities' END AS gap FROM l""",
)
def f27(t):
    st = F.col("o_orderstatus")
    none = F.array().cast("array<string>")
    issues = F.when(st == "O", F.array(F.lit("Missing citation"), F.lit("Incomplete coverage"))).when(
        st == "F", F.array(F.lit("No Precedent given"))).otherwise(none)
    kinds = F.when(st == "O", F.array(F.lit("statute"))).when(st == "F", F.array(F.lit("case_law"))).otherwise(none)
    category = F.when(st == "O", "corporate").when(st == "F", "constitutional").otherwise("other")
    return questions(t).select(
        "query_id",
        fq.rewrite_query("query", fq.jurisdiction_of("query"), interest=F.lit("tax")).alias("rewritten"),
        F.coalesce(F.get(fq.category_variants("query", category), F.lit(1)), F.col("query")).alias("variant"),
        fq.gap_query("query", issues, kinds).alias("gap"),
    )
