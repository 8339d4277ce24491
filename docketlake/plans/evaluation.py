"""Quality gates, evaluation and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.constants import CONSTITUTION_TERMS, LENGTH_MARKERS, SENTENCE_WORDS, STRUCTURE_MARKERS, TRANSITION_WORDS
from docketlake.functions import text as tx
from docketlake.operators import catalog as ca, evaluation as ev, quality as qu, retrieval as rt
from docketlake.plans.common import SWS, sql_any, sql_collapse, sql_strip, sql_words
from docketlake.plans.registry import query

# --- answers made from conversations -----------------------------------------

ANSWER_SQL = """ans AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, role, replace(replace(replace(text, ', ', ' [Source 2], '), '. ', ' (Source: Act 1). "'), chr(10), '" therefore' || chr(10)) AS answer, text FROM conversations)"""


def answers(t):
    a = F.replace(F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" [Source 2], ")), F.lit(". "), F.lit(' (Source: Act 1). "')), F.lit("\n"), F.lit('" therefore\n'))
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "role", a.alias("answer"), "text")


ATTR = r"""list_filter(string_split(answer, '.'), lambda s: length({0}) > 20)""".format(sql_strip("s"))


@query(
    "f30_attribution",
    rf"""WITH {ANSWER_SQL}, f AS (SELECT query_id, answer, {ATTR} AS ss, len(regexp_extract_all(answer, '\[Source \d+\]')) AS n FROM ans)
    SELECT query_id, round(n / greatest(len(ss), 1), 6) AS citation_ratio, n / greatest(len(ss), 1) >= 0.33 AS attributed,
    CASE WHEN n / greatest(len(ss), 1) >= 0.33 THEN 0 ELSE least(5, len(list_filter(ss, lambda s: NOT regexp_matches(s, '\[Source \d+\]')))) END AS missing FROM f""",
)
def f30(t):
    return answers(t).withColumns(qu.attribution("answer")).select(
        "query_id", F.round("citation_ratio", 6).alias("citation_ratio"), "attributed", F.size("missing_citations").alias("missing"))


@query(
    "f30_citation_density",
    rf"""WITH {ANSWER_SQL} SELECT query_id, len(regexp_extract_all(answer, '\(Source: [^)]+\)')) AS citation_count,
    round(len(regexp_extract_all(answer, '\(Source: [^)]+\)')) / greatest(1, len({sql_words('answer')})) * 100, 2) AS citation_density FROM ans""",
)
def f30d(t):
    return answers(t).withColumns(qu.citation_density("answer")).select("query_id", "citation_count", "citation_density")


CONTEXT_SQL = """contexts AS (SELECT a.conv_id * 1000 + a.turn AS query_id, c.turn + 1 AS position, c.text AS content, c.role AS title FROM conversations a JOIN conversations c USING (conv_id))"""


def contexts(t):
    a = t.conversations.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"))
    c = t.conversations.select("conv_id", (F.col("turn") + 1).alias("position"), F.col("text").alias("content"), F.col("role").alias("title"))
    return a.join(c, "conv_id").drop("conv_id")


@query(
    "j11_citation_resolution",
    rf"""WITH {ANSWER_SQL}, {CONTEXT_SQL}, m AS (SELECT query_id, unnest(regexp_extract_all(answer, '\[Source (\d+)\]', 1))::INTEGER AS position FROM ans)
    SELECT query_id, position, title, count(*) AS mentions FROM m JOIN contexts USING (query_id, position) GROUP BY ALL""",
)
def j11(t):
    r = qu.resolve_citations(answers(t), contexts(t).withColumn("position", F.col("position").cast("int")))
    return r.groupBy("query_id", "position", "title").agg(F.count("*").alias("mentions"))


@query(
    "j12_quote_verification",
    rf"""WITH {ANSWER_SQL}, {CONTEXT_SQL}, q AS (SELECT query_id, generate_subscripts(qs, 1) AS n, unnest(qs) AS quote FROM (SELECT query_id, regexp_extract_all(answer, '"([^"]{{20,}})"', 1) AS qs FROM ans)),
    v AS (SELECT *, EXISTS (SELECT 1 FROM contexts c WHERE c.query_id = q.query_id AND contains(lower(c.content), lower(q.quote))) AS ok FROM q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, ok ORDER BY n) AS k FROM v)
    SELECT query_id, bool_and(ok) AS all_verified, count(*) FILTER (ok) AS verified_count,
    coalesce(string_agg(CASE WHEN length(quote) > 100 THEN left(quote, 100) || '...' ELSE quote END, ' | ' ORDER BY n) FILTER (NOT ok AND k <= 3), '') AS unverified_quotes FROM r GROUP BY query_id""",
)
def j12(t):
    return qu.verify_quotes(answers(t), contexts(t))


@query(
    "f32_clarity",
    f"""WITH {ANSWER_SQL} SELECT query_id, round(greatest(0.0, 1.0 - CASE WHEN {sql_any('answer', STRUCTURE_MARKERS)} THEN 0 ELSE 0.3 END - CASE WHEN {sql_any('lower(answer)', TRANSITION_WORDS)} THEN 0 ELSE 0.2 END
    - CASE WHEN length(answer) > 2000 AND NOT {sql_any('answer', LENGTH_MARKERS)} THEN 0.2 ELSE 0 END), 6)::DOUBLE AS clarity, {sql_any('answer', CONSTITUTION_TERMS)} AS constitution_aware FROM ans""",
)
def f32(t):
    return answers(t).select("query_id", F.round(qu.clarity_score("answer"), 6).alias("clarity"), qu.constitution_aware("answer").alias("constitution_aware"))


@query(
    "f33_hierarchy_check",
    r"""SELECT o_orderkey AS query_id, NOT bad_order AND NOT few AS hierarchy_passed, CASE WHEN bad_order OR few THEN 0.6 ELSE 0.9 END::DOUBLE AS hierarchy_confidence, bad_order::INTEGER + few::INTEGER AS issues
    FROM (SELECT *, o_orderstatus = 'O' AS bad_order, o_orderpriority IN ('1-URGENT', '2-HIGH') AS few FROM orders)""",
)
def f33(t):
    text = F.when(F.col("o_orderstatus") == "O", "The Act says so, the Constitution too").otherwise("The Constitution and the Act")
    cites = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "").otherwise(" (Source: Act 1)")
    rows = t.dealt("orders", "o_orderkey").select(F.col("o_orderkey").alias("query_id"), F.concat(text, cites).alias("answer"),
                           F.array(F.lit("constitution"), F.lit("act")).alias("kinds"))
    return rows.withColumns(qu.hierarchy_check("answer", "kinds")).select(
        "query_id", "hierarchy_passed", "hierarchy_confidence", F.size("hierarchy_issues").alias("issues"))


# --- sentences and extractive answers ----------------------------------------

SENT_CTE = rf"""pieces AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS p0 FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+') AS ps FROM documents)),
sents AS (SELECT doc_id, pos, sentence, n, CASE WHEN n BETWEEN 5 AND 25 THEN 2 WHEN n > 25 THEN 1 ELSE 0 END + len(list_filter({sql_words('lower(sentence)')}, lambda w: list_contains({SENTENCE_WORDS}, w))) AS score
  FROM (SELECT doc_id, pos, {sql_strip('p0')} AS sentence, len({sql_words(sql_strip('p0'))}) AS n FROM pieces) WHERE length(sentence) > 10)"""


@query("f31_sentence_scores", f"WITH {SENT_CTE} SELECT doc_id, pos, score AS sentence_score FROM sents")
def f31(t):
    return rt.sentence_rows(t.dealt("documents", "doc_id"), "text", ["doc_id"]).select("doc_id", "pos", "sentence_score")


@query("t5_key_sentences", f"""WITH {SENT_CTE} SELECT doc_id, r AS sentence_rank, md5(sentence) AS sentence_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM sents) WHERE r <= 3""")
def t5(t):
    return rt.key_sentences(t.dealt("documents", "doc_id"), "text", ["doc_id"]).select("doc_id", "sentence_rank", F.md5("sentence").alias("sentence_md5"))


@query(
    "f40_extractive_answers",
    rf"""WITH rk AS (SELECT source AS query_id, text, lang || doc_id AS title, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
    top3 AS (SELECT query_id, ' ' || string_agg(text, ' ' ORDER BY r) AS text, string_agg(title || ' (' || printf('%.3f', 1.0 / r) || ')', '; ' ORDER BY r) AS citations FROM rk WHERE r <= 3 GROUP BY 1),
    pieces AS (SELECT query_id, citations, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS p0 FROM (SELECT query_id, citations, regexp_split_to_array(text, '[.!?]+') AS ps FROM top3)),
    sents AS (SELECT *, CASE WHEN n BETWEEN 5 AND 25 THEN 2 WHEN n > 25 THEN 1 ELSE 0 END + len(list_filter({sql_words('lower(sentence)')}, lambda w: list_contains({SENTENCE_WORDS}, w))) AS score
      FROM (SELECT query_id, citations, pos, {sql_strip('p0')} AS sentence, len({sql_words(sql_strip('p0'))}) AS n FROM pieces) WHERE length(sentence) > 10),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k FROM sents),
    a AS (SELECT query_id, citations, string_agg(sentence, '. ' ORDER BY k) FILTER (k <= 2) AS tl,
      string_agg(CASE WHEN n > 25 THEN array_to_string(list_slice({sql_words('sentence')}, 1, 25), ' ') || '...' ELSE sentence END, ' | ' ORDER BY k) AS key_points FROM b WHERE k <= 5 GROUP BY ALL)
    SELECT query_id, CASE WHEN length(tl) > 220 THEN left(tl, 217) || '...' ELSE tl END AS tldr, key_points, citations FROM a""",
)
def f40(t):
    from docketlake.operators.fusion import top_k

    ranked = top_k(t.documents, 3, ["source"], [F.desc("n_chars"), F.asc("doc_id")])
    rows = ranked.select(F.col("source").alias("query_id"), "rank", F.col("text").alias("chunk_text"), F.concat("lang", "doc_id").alias("title"), (1.0 / F.col("rank")).alias("score"))
    return rt.extractive_answers(rows)


# --- gates -------------------------------------------------------------------


@query(
    "p18_retrieval_checks",
    """WITH p AS (SELECT l_orderkey AS query_id, count(*) FILTER (l_linestatus = 'O') AS n, count(DISTINCT l_returnflag) FILTER (l_linestatus = 'O') AS s, max((l_quantity > 40)::INTEGER) AS parents, max(l_discount * 10) AS c FROM lineitem GROUP BY 1)
    SELECT query_id, n > 0 AS has_results, c >= 0.3 AS confidence_threshold, s > 1 AS diverse_sources, parents > 0 AS has_parent_docs,
    coalesce(array_to_string([CASE WHEN n = 0 THEN 'No relevant documents found' END, CASE WHEN c < 0.3 THEN 'Low retrieval confidence' END, CASE WHEN s <= 1 THEN 'Results from single source only' END], '; '), '') AS warnings FROM p""",
)
def p18(t):
    return gate_hits(t).drop("next_step")


def gate_hits(t):
    hits = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("chunk_id"), F.col("l_returnflag").alias("source"),
        (F.col("l_discount") * 10).alias("retrieval_confidence"), (F.col("l_quantity") > 40).alias("has_parent"))
    return qu.retrieval_checks(hits).withColumn("warnings", F.array_join("warnings", "; "))


@query("p19_route", """SELECT l_orderkey AS query_id, CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 AND max(l_discount * 10) >= 0.3 THEN 'synthesize' ELSE 'fallback' END AS next_step FROM lineitem GROUP BY 1""")
def p19(t):
    return gate_hits(t).select("query_id", "next_step")


@query(
    "p18_synthesis_checks",
    """SELECT doc_id AS query_id, length(x) > 0 AS has_tldr, length(x) >= 50 AS tldr_length, lang <> 'de' AS has_key_points, lang <> 'fr' AS has_citations, n_chars >= 900 AS confidence_acceptable,
    coalesce(array_to_string([CASE WHEN length(x) < 50 THEN 'Response summary too short' END, CASE WHEN lang = 'de' THEN 'No key points generated' END, CASE WHEN lang = 'fr' THEN 'No citations provided' END], '; '), '') AS warnings
    FROM (SELECT *, split_part(text, chr(10), 1) AS x FROM documents)""",
)
def p18s(t):
    one, none = F.array(F.lit("x")), F.array().cast("array<string>")
    rows = t.dealt("documents", "doc_id").select(
        F.col("doc_id").alias("query_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("tldr"), F.when(F.col("lang") == "de", none).otherwise(one).alias("key_points"),
        F.when(F.col("lang") == "fr", none).otherwise(one).alias("citations"), (F.col("n_chars") / 3000).alias("confidence"))
    return qu.synthesis_checks(rows).withColumn("warnings", F.array_join("warnings", "; "))


REFINE_SQL = """CASE WHEN o_custkey % 11 = 0 THEN 'pass' WHEN i >= 2 THEN 'fail' WHEN ok AND c > 0.8 THEN 'pass' WHEN o_orderpriority = '1-URGENT' THEN 'retrieve_more'
    WHEN c > 0.5 AND c < 0.8 AND o_orderpriority = '2-HIGH' THEN 'refine_synthesis' WHEN lv = 'expert' AND c < 0.7 THEN 'refine_synthesis' WHEN c >= 0.6 AND c < 0.8 AND o_orderpriority <> '5-LOW' THEN 'refine_synthesis' ELSE 'pass' END"""
REFINE_CTE = f"""dec AS (SELECT o_orderkey AS query_id, lv AS complexity, {REFINE_SQL} AS decision FROM (SELECT *, (o_custkey % 100)::DOUBLE / 100 AS c, o_orderkey % 3 AS i, o_orderstatus = 'O' AS ok, CASE o_orderstatus WHEN 'F' THEN 'expert' WHEN 'O' THEN 'simple' ELSE 'moderate' END AS lv FROM orders))"""


def decisions(t):
    p, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    issues = F.when(p == "1-URGENT", F.array(F.lit("Missing Source"))).when(p == "2-HIGH", F.array(F.lit("weak LOGIC"))).when(
        p == "5-LOW", F.array().cast("array<string>")).otherwise(F.array(F.lit("other")))
    level = F.when(st == "F", "expert").when(st == "O", "simple").otherwise("moderate")
    conf = F.when(F.col("o_custkey") % 11 != 0, (F.col("o_custkey") % 100).cast("double") / 100)
    return t.orders.select(
        F.col("o_orderkey").alias("query_id"), level.alias("complexity"),
        qu.refinement_step(st == "O", conf, issues, level, F.col("o_orderkey") % 3).alias("decision"))


@query("p20_refinement_step", f"WITH {REFINE_CTE} SELECT query_id, complexity, decision FROM dec")
def p20(t):
    return decisions(t)


@query(
    "a15_trigger_rates",
    f"""WITH {REFINE_CTE} SELECT coalesce(complexity, '(all)') AS level, count(*) AS n, round(avg((decision IN ('refine_synthesis', 'retrieve_more'))::INTEGER) * 100, 4) AS trigger_rate,
    count(*) FILTER (decision = 'pass') AS pass, count(*) FILTER (decision = 'fail') AS fail, count(*) FILTER (decision = 'refine_synthesis') AS refine_synthesis, count(*) FILTER (decision = 'retrieve_more') AS retrieve_more
    FROM dec GROUP BY ROLLUP (complexity)""",
)
def a15(t):
    return ev.trigger_rates(decisions(t))


@query(
    "p21_relevance_gate",
    """WITH c AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS doc_key, bool_or(l_returnflag = 'A') OVER (PARTITION BY l_orderkey, l_partkey) AS r FROM lineitem),
    g AS (SELECT query_id, count(*) AS before, count(*) FILTER (r) AS after FROM c GROUP BY 1)
    SELECT query_id, before, after, round(after / before, 6) AS relevance_ratio, after >= 2 AND after / before >= 0.6 AS passed,
    coalesce(array_to_string([CASE WHEN after < 2 THEN 'Insufficient relevant sources: ' || after || ' < 2' END, CASE WHEN after / before < 0.6 THEN printf('Low relevance ratio: %.2f < 0.6', after / before) END], '; '), '') AS issues FROM g""",
)
def p21(t):
    pairs = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_key"), "l_returnflag")
    gate = qu.relevance_gate(pairs.select("query_id", "doc_key").distinct(), pairs.where(F.col("l_returnflag") == "A"))
    return gate.withColumn("issues", F.array_join("issues", "; "))


@query(
    "a28_gate_rollup",
    """SELECT l_orderkey AS query_id, bool_and(l_returnflag <> 'R') AS passed, count(*) FILTER (l_returnflag = 'R') AS issues,
    CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN greatest(0.1, round(1.0 - count(*) FILTER (l_returnflag = 'R') * 0.2, 6)) ELSE 1.0 END::DOUBLE AS confidence FROM lineitem GROUP BY 1""",
)
def a28(t):
    return qu.gate_rollup(t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") != "R").alias("passed"), F.concat(F.lit("Logic: "), "l_linestatus").alias("issue")))


@query(
    "a27_quality_score",
    """WITH s AS (SELECT o_orderkey AS query_id, round(CASE WHEN o_orderstatus = 'O' THEN least(100.0, (o_custkey % 100)::DOUBLE / 100 * 100 + 20) ELSE (o_custkey % 100)::DOUBLE / 100 * 100 END, 1) AS attribution,
      CASE o_orderpriority WHEN '1-URGENT' THEN 95 WHEN '2-HIGH' THEN 75 WHEN '3-MEDIUM' THEN 25 ELSE 50 END::DOUBLE AS coherence, round((o_orderkey % 50)::DOUBLE / 50 * 100, 1) AS relevance,
      round(least(100.0, (o_custkey % 7)::DOUBLE / greatest(1.0, (o_orderkey % 400)::DOUBLE / 100) * 50), 1) AS citation_density FROM orders)
    SELECT *, round(o, 1) AS overall, CASE WHEN o >= 90 THEN 'A+' WHEN o >= 85 THEN 'A' WHEN o >= 80 THEN 'B+' WHEN o >= 75 THEN 'B' WHEN o >= 70 THEN 'C+' WHEN o >= 65 THEN 'C' ELSE 'F' END AS grade
    FROM (SELECT *, round(attribution * 0.3::DOUBLE + coherence * 0.3::DOUBLE + relevance * 0.2::DOUBLE + citation_density * 0.2::DOUBLE, 6) AS o FROM s)""".replace("SELECT *, round(o, 1)", "SELECT query_id, attribution, coherence, relevance, citation_density, round(o, 1)"),
)
def a27(t):
    p = F.col("o_orderpriority")
    word = F.when(p == "1-URGENT", "excellent").when(p == "2-HIGH", "acceptable").when(p == "3-MEDIUM", "unacceptable").otherwise("odd")
    cols = qu.quality_score(
        (F.col("o_custkey") % 100).cast("double") / 100, F.col("o_orderstatus") == "O", word, (F.col("o_orderkey") % 50).cast("double") / 50,
        F.col("o_custkey") % 7, F.col("o_orderkey") % 400)
    return t.orders.select(F.col("o_orderkey").alias("query_id"), *[c.alias(n) for n, c in cols.items()])


@query(
    "f37_signup_fields",
    r"""SELECT c_custkey, lower(replace(c_name, '#', '@')) || '.example.com' AS email, lower(c_mktsegment) AS source, c_nationkey = 3 AS is_bot, c_nationkey <> 3 AS valid FROM customer""",
)
def f37(t):
    mail = F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), F.lit("@")), F.lit(".Example.com "))
    fields = qu.signup_fields(mail, F.concat("c_mktsegment", F.lit(" ")), F.when(F.col("c_nationkey") == 3, "spam"))
    return t.customer.select("c_custkey", *[c.alias(n) for n, c in fields.items()])


# --- golden sets -------------------------------------------------------------

GOLD_CTE = f"""gold AS (SELECT item_id AS id, text AS expected_answer, list_transform(list_slice({sql_words('text')}, 1, 3), lambda x: lower(x)) AS es, CASE WHEN length(text) < 220 THEN 'short' ELSE 'long' END AS category,
    CASE WHEN length(text) < 200 THEN 'simple' WHEN length(text) < 250 THEN 'moderate' ELSE 'complex' END AS complexity, list_distinct(list_transform({sql_words('text')}, lambda x: lower(x))) AS ew FROM benchmark),
res AS (SELECT conv_id * 1000 + turn AS run, conv_id % 40 AS id, text AS answer, string_split(text, '. ') AS sources, length(text) * 40 AS latency_ms, (turn + 5) / 12.0 AS confidence, role FROM conversations),
sc AS (SELECT g.*, r.*, round(len(list_filter(ew, lambda w: list_contains(aw, w))) / len(ew), 9) AS correctness, round(len(list_filter(es, lambda e: len(list_filter(sources, lambda s: contains(lower(s), e))) > 0)) / len(es), 9) AS citation,
    least(1.0, greatest(0.0, 1.0 - (latency_ms - 5000) / 5000.0)) AS performance FROM gold g JOIN (SELECT *, list_distinct(list_transform({sql_words('answer')}, lambda x: lower(x))) AS aw FROM res) r USING (id)),
scored AS (SELECT *, correctness * 0.5 + citation * 0.3 + performance * 0.2 AS overall, correctness >= 0.1 AS any_words, correctness >= 0.7 AND citation >= 0.6 AND confidence >= 0.5 AND latency_ms <= 10000 AS passed FROM sc)"""


def golden(t):
    ws = F.transform(tx.words("text"), F.lower)
    n = F.length("text")
    return t.benchmark.select(
        F.col("item_id").alias("id"), F.col("text").alias("expected_answer"), F.slice(ws, 1, 3).alias("expected_sources"),
        F.when(n < 220, "short").otherwise("long").alias("category"), F.when(n < 200, "simple").when(n < 250, "moderate").otherwise("complex").alias("complexity"),
        F.lit(0.5).alias("expected_confidence_min"))


def scored(t):
    res = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("run"), (F.col("conv_id") % 40).alias("id"), F.col("text").alias("answer"), F.split("text", r"\. ").alias("sources"),
        (F.length("text") * 40).alias("latency_ms"), ((F.col("turn") + 5) / 12).alias("confidence"), "role")
    return ev.score_answers(golden(t), res)


@query("f34_answer_scores", f"WITH {GOLD_CTE} SELECT run, round(correctness, 6) AS correctness, round(performance, 6)::DOUBLE AS performance, round(overall, 6)::DOUBLE AS overall, passed FROM scored")
def f34(t):
    return scored(t).select("run", *[F.round(c, 6).alias(c) for c in ("correctness", "performance", "overall")], "passed")


@query("j13_citation_accuracy", f"WITH {GOLD_CTE} SELECT run, round(citation, 6) AS citation FROM scored")
def j13(t):
    return scored(t).select("run", F.round("citation", 6).alias("citation"))


@query("j14_golden_categories", f"WITH {GOLD_CTE} SELECT category, complexity, count(*) AS n FROM scored GROUP BY ALL")
def j14(t):
    return scored(t).groupBy("category", "complexity").agg(F.count("*").alias("n"))


@query(
    "a12_golden_summary",
    f"""WITH {GOLD_CTE} SELECT count(*) AS total_queries, sum(passed::INTEGER)::BIGINT AS passed_queries, round(avg(passed::INTEGER), 6) AS pass_rate, round(avg(correctness), 6) AS avg_correctness, round(avg(citation), 6) AS avg_citation,
    round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(confidence), 6)::DOUBLE AS avg_confidence, avg(correctness) >= 0.9 AS correctness_passed, avg(citation) >= 0.95 AS citation_passed, avg(latency_ms) <= 5000 AS latency_passed,
    avg(correctness) >= 0.9 AND avg(citation) >= 0.95 AND avg(latency_ms) <= 5000 AS overall_passed FROM scored""",
)
def a12(t):
    s = ev.golden_summary(scored(t))
    return s.withColumns({c: F.round(c, 6) for c in ("pass_rate", "avg_correctness", "avg_citation", "avg_latency_ms", "avg_confidence")})


@query(
    "a13_category_breakdown",
    f"""WITH {GOLD_CTE} SELECT coalesce(category, '(all)') AS category, count(*) AS total, sum(passed::INTEGER)::BIGINT AS passed, round(avg(passed::INTEGER), 6) AS pass_rate, round(avg(overall), 6)::DOUBLE AS avg_score,
    round(avg(latency_ms), 6) AS avg_latency FROM scored GROUP BY ROLLUP (category)""",
)
def a13(t):
    return ev.category_breakdown(scored(t)).withColumns({c: F.round(c, 6) for c in ("pass_rate", "avg_score", "avg_latency")})


TOPIC_CTE = f"""{GOLD_CTE}, tp AS (SELECT run, id, complexity, role AS rerank_method, es, list_transform({sql_words('answer')}, lambda x: lower(x)) AS rw FROM scored),
pr AS (SELECT *, list_distinct(es) AS e, list_distinct(list_slice(rw, 1, 5)) AS r5, list_distinct(list_slice(rw, 1, 10)) AS r10 FROM tp),
pk AS (SELECT run, complexity, rerank_method, len(list_filter(e, lambda x: len(list_filter(r5, lambda y: contains(y, x) OR contains(x, y))) > 0)) / len(e) AS p5,
    len(list_filter(e, lambda x: len(list_filter(r10, lambda y: contains(y, x) OR contains(x, y))) > 0)) / len(e) AS p10,
    len(list_filter(e, lambda x: list_contains(r5, x))) / len(list_distinct(list_concat(e, r5))) AS jac FROM pr)"""


def topics(t):
    rows = scored(t).withColumn("_r", F.transform(tx.words("answer"), F.lower))
    return rows.select(
        "run", "complexity", F.col("role").alias("rerank_method"), ev.precision_at_k("_r", "expected_sources", 5).alias("precision_5"),
        ev.precision_at_k("_r", "expected_sources", 10).alias("precision_10"), ev.doc_type_jaccard(F.slice("_r", 1, 5), "expected_sources").alias("doc_type_score"))


@query("f35_precision_at_k", f"WITH {TOPIC_CTE} SELECT run, round(p5, 6) AS precision_5, round(p10, 6) AS precision_10 FROM pk")
def f35(t):
    return topics(t).select("run", F.round("precision_5", 6).alias("precision_5"), F.round("precision_10", 6).alias("precision_10"))


@query("u5_doc_type_jaccard", f"WITH {TOPIC_CTE} SELECT run, round(jac, 6) AS doc_type_score FROM pk")
def u5(t):
    return topics(t).select("run", F.round("doc_type_score", 6).alias("doc_type_score"))


@query(
    "a14_retrieval_summary",
    f"""WITH {TOPIC_CTE}, g AS (SELECT 'total' AS scope, '(all)' AS value, * FROM pk UNION ALL SELECT 'complexity', complexity, * FROM pk UNION ALL SELECT 'rerank_method', rerank_method, * FROM pk)
    SELECT scope, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM pk) * 100, 1) AS share_pct, round(avg(p5), 3) AS avg_precision_5, round(avg(p10), 3) AS avg_precision_10, round(avg(jac), 3) AS avg_doc_type_match,
    round((round(avg(p5), 3) - 0.5) / 0.5 * 100, 1) AS avg_precision_5_change_pct, round((round(avg(p10), 3) - 0.4::DOUBLE) / 0.4::DOUBLE * 100, 1) AS avg_precision_10_change_pct FROM g GROUP BY ALL""",
)
def a14(t):
    return ev.retrieval_summary(topics(t), (0.5, 0.4))


# --- catalogs ----------------------------------------------------------------

HEAD_JS = '<script id="track-page-properties">{{"work_frbr_uri": "/akn/zw/{kind}/2020/{id}", "expression_frbr_uri": "/akn/zw/{kind}/2020/{id}/eng@2021-02-03", "frbr_uri_number": "2020"}}</script>'


def with_properties(t, kinds):
    """Pages with tracked properties in front and a chapter line behind."""
    i = F.col("page_id").cast("string")
    kind = F.lit(kinds[-1])
    for lang, k in kinds[:-1]:
        kind = F.when(F.contains(F.col("html"), F.lit(f'lang="{lang}"')), k).otherwise(kind)
    js = F.concat(
        F.lit('<script id="track-page-properties">{"work_frbr_uri": "/akn/zw/'), kind, F.lit("/2020/"), i,
        F.lit('", "expression_frbr_uri": "/akn/zw/'), kind, F.lit("/2020/"), i, F.lit('/eng@2021-02-03", "frbr_uri_number": "2020"}</script>'))
    return t.pages.select("page_id", "url", F.concat(js, F.col("html"), F.lit("<p>Chapter <b>7</b></p><p>chapter 28:01</p>")).alias("html"))


KIND_SQL = """CASE WHEN contains(html, 'lang="en"') THEN 'act/si' WHEN contains(html, 'lang="de"') THEN 'act/ord' ELSE 'act' END"""
LEG_KINDS = [("de", "act/ord"), ("en", "act/si"), "act"]
UNESC = "replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
LEG_CTE = f"""leg AS (SELECT page_id, url, {KIND_SQL} AS kind, {sql_strip(UNESC.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages),
cat AS (SELECT page_id, url, '/akn/zw/' || kind || '/2020/' || page_id AS akn_uri, CASE kind WHEN 'act/si' THEN 'Statutory Instrument' WHEN 'act/ord' THEN 'Ordinance' ELSE 'Act' END AS nature, title, '28:01' AS chapter, '2021-02-03' AS effective_date, 2020 AS year FROM leg)"""


def leg_catalog(t):
    return ca.legislation_catalog(with_properties(t, LEG_KINDS), site="https://law.example.org")


@query("f19_legislation_catalog", f"WITH {LEG_CTE} SELECT url, akn_uri, nature, title, chapter, effective_date, year, 'https://law.example.org' || akn_uri || '/eng@2021-02-03' AS source_url FROM cat")
def f19(t):
    return leg_catalog(t).select("url", "akn_uri", "nature", "title", "chapter", "effective_date", "year", "source_url")


@query("a10_catalog_counts", f"WITH {LEG_CTE} SELECT nature, count(*) AS n FROM cat GROUP BY 1")
def a10(t):
    return ca.counts_by(leg_catalog(t), "nature")


@query("w15_first_per_key", f"WITH {LEG_CTE} SELECT nature AS akn_uri, min(url) AS url FROM cat GROUP BY 1")
def w15(t):
    return ca.first_per_key(leg_catalog(t).withColumn("akn_uri", F.col("nature"))).select("akn_uri", "url")


@query("p15_catalog_filters", f"WITH {LEG_CTE} SELECT akn_uri FROM cat WHERE year IN (2019, 2020) AND nature = 'Act'")
def p15(t):
    c = leg_catalog(t).withColumn("court_code", F.col("nature"))
    return ca.filter_catalog(c, years=[2019, 2020], start_year=2000, end_year=2024, court="Act").select("akn_uri")


def judgments(t):
    i = F.col("page_id").cast("string")
    p = with_properties(t, [("en", "judgment/zwsc"), "judgment/zwhhc"])
    head = F.concat(
        F.lit("<title>Ndlovu "), F.when(F.col("page_id") % 2 == 0, "v").otherwise("v."), F.lit(" Moyo [2020] ZWSC "), i, F.lit(" (1 August 2021) "))
    detail = F.lit('<dl><dt>Judges</dt><dd>Makarau JA, Bere J</dd></dl><span class="badge">Labour</span><p>Subject: Tax, Duty</p><a href="/x/y.pdf">Download PDF</a>')
    return ca.judgment_catalog(p.withColumn("html", F.concat(F.replace(F.col("html"), F.lit("<title>"), head), detail)))


@query(
    "f20_judgment_catalog",
    """SELECT page_id, CASE WHEN contains(html, 'lang="en"') THEN 'Supreme Court of Zimbabwe' ELSE 'High Court of Zimbabwe (Harare)' END AS court, '[2020] ZWSC ' || page_id AS citation,
    CASE WHEN page_id % 2 = 0 THEN 'Ndlovu v Moyo' ELSE 'Ndlovu v. Moyo' END AS case_name, 'unknown of 2020' AS case_number, '2021-02-03' AS judgment_date, 'English' AS language, 'Makarau JA|Bere J' AS judges, 'Labour|Tax|Duty' AS topics, 'Ndlovu' AS plaintiff, 'Moyo' AS defendant,
    CASE WHEN page_id % 2 = 0 THEN 'Ndlovu v Moyo' ELSE 'Ndlovu v. Moyo' END || ' (unknown of 2020) [2020] ZWSC ' || page_id || ' (03 February 2021)' AS citation_full FROM pages""",
)
def f20(t):
    j = judgments(t)
    return j.select(
        "page_id", "court", "citation", "case_name", "case_number", "judgment_date", "language", F.array_join("judges", "|").alias("judges"),
        F.array_join("topics", "|").alias("topics"), F.array_join(F.element_at("parties", F.lit("plaintiff")), "|").alias("plaintiff"),
        F.array_join(F.element_at("parties", F.lit("defendant")), "|").alias("defendant"), "citation_full")


@query("f7_judgment_file_names", """SELECT page_id, CASE WHEN contains(html, 'lang="en"') THEN 'zwsc' ELSE 'zwhhc' END || '_2020_' || page_id || '_eng_2021-02-03_ndlovu_v_moyo_' ||
    substr(sha1('/akn/zw/judgment/' || CASE WHEN contains(html, 'lang="en"') THEN 'zwsc' ELSE 'zwhhc' END || '/2020/' || page_id || '/eng@2021-02-03'), 1, 8) || '.pdf' AS pdf_name FROM pages""")
def f7j(t):
    return judgments(t).select("page_id", "pdf_name")


@query(
    "f21_links",
    r"""WITH m AS (SELECT url AS page_url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>', 1)) AS href FROM pages)
    SELECT page_url, href, count(*) AS n, bool_or(lower(href) LIKE '%.pdf') AS is_pdf, bool_or(contains(href, '/akn/zw/judgment/')) AS is_judgment FROM m GROUP BY ALL""",
)
def f21(t):
    return ca.links(t.pages).groupBy("page_url", "href").agg(F.count("*").alias("n"), F.max("is_pdf").alias("is_pdf"), F.max("is_judgment").alias("is_judgment"))


@query("f21_index_rows", """SELECT url AS page_url, '/akn/zw/act/' || page_id AS href, '7:0' || (page_id % 10) AS chapter FROM pages""")
def f21i(t):
    i = F.col("page_id").cast("string")
    table = F.concat(
        F.lit('<div class="table-responsive"><table class="doc-table"><tr><th>Title</th></tr><tr><td><a href="/akn/zw/act/'), i,
        F.lit('">An Act</a></td><td>Chapter 7:0'), (F.col("page_id") % 10).cast("string"), F.lit("</td></tr></table></div>"))
    return ca.index_rows(t.pages.withColumn("html", F.concat(F.col("html"), table)))


@query("f21_listed_years", "SELECT DISTINCT 1990 + page_id % 30 AS year FROM pages")
def f21y(t):
    link = F.concat(F.lit('<a href="/y"> '), (1990 + F.col("page_id") % 30).cast("string"), F.lit(' </a><a href="/z">1950</a>'))
    return ca.listed_years(t.pages.withColumn("html", F.concat(F.col("html"), link)))
