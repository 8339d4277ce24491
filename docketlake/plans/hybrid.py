"""Embedding, reranking and the whole hybrid search over chunks, with letter counts as vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docketlake.functions import ids, text as tx
from docketlake.operators import retrieval as rt
from docketlake.operators.bm25 import bm25_search, build_bm25
from docketlake.operators.chunking import register_functions
from docketlake.operators.fusion import complexity_value, search_confidence, top_k
from docketlake.operators.vectors import embed, vector_search
from docketlake.plans.analytics import TWO_LEVEL_CTE, lookups
from docketlake.plans.common import chunks, sql_chunk_id, sql_words
from docketlake.plans.ingest import ENTITY_CTE, SPLIT_CTE, legal_chunks
from docketlake.plans.registry import query
from docketlake.plans.search import BM25_CTE, CHUNK_CTE, benchmark_hits, benchmark_queries
from docketlake.plans.text import NQ
from docketlake.session import materialize

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)


def letter_vector(col: str):
    c = F.col(col)
    return F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("float") for x in LETTERS])


def sql_letters(c: str) -> str:
    return "[" + ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::DOUBLE" for x in LETTERS) + "]"


@query("r3_embed", f"WITH {CHUNK_CTE} SELECT chunk_id, list_sum({sql_letters('chunk_text')}) AS total, {sql_letters('chunk_text')}[5] AS fifth, true AS embedded FROM chunks")
def r3(t):
    e = embed(chunks(t).select("chunk_id", "chunk_text"), letter_counts, 26)
    return e.select(
        "chunk_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("embedding", F.lit(4)).cast("double").alias("fifth"), "embedded")


def chunk_vectors(c):
    return c.select(F.col("chunk_id").alias("item_id"), letter_vector("chunk_text").alias("embedding"))


@query(
    "r4_variant_search",
    rf"""WITH {CHUNK_CTE}, vq AS (SELECT item_id AS query_id, text || ' s 5' AS query FROM benchmark), b AS (SELECT query_id, {NQ} AS n FROM vq),
    v AS (SELECT query_id, generate_subscripts(vs, 1) - 1 AS variant_idx, unnest(vs) AS variant FROM (SELECT query_id, list_filter([n, CASE WHEN sp <> n THEN sp END], lambda x: x IS NOT NULL) AS vs FROM (SELECT *, regexp_replace(n, '(?i)\bs\.?\s*(\d+[A-Za-z]?)', 'section \1', 'g') AS sp FROM b))),
    qv AS (SELECT query_id, variant_idx, {sql_letters('variant')} AS qv FROM v), cv AS (SELECT chunk_id AS item_id, {sql_letters('chunk_text')} AS cv FROM chunks),
    s AS (SELECT query_id, variant_idx, item_id, CASE WHEN list_sum(cv) = 0 OR list_sum(qv) = 0 THEN 0 ELSE round(list_cosine_similarity(qv, cv), 6) END AS score FROM qv, cv)
    SELECT query_id, variant_idx, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_idx ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10""",
)
def r4(t):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" s 5")).alias("query"))
    return rt.multi_variant_search(chunk_vectors(chunks(t)), q, letter_counts, 26, 10)


LEVEL_SQL = "CASE WHEN length(text) < 180 THEN 'simple' WHEN length(text) < 220 THEN 'moderate' WHEN length(text) < 260 THEN 'complex' ELSE 'expert' END"
SIZES = "sizes AS (SELECT * FROM (VALUES ('simple', 15, 5), ('moderate', 25, 8), ('complex', 40, 12), ('expert', 50, 15)) v(complexity, fetch_k, keep_k))"


def leveled_queries(t):
    n = F.length("query")
    return benchmark_queries(t).withColumn(
        "complexity", F.when(n < 180, "simple").when(n < 220, "moderate").when(n < 260, "complex").otherwise("expert"))


def sql_low_words(c):
    return f"list_distinct(list_transform({sql_words(c)}, lambda x: lower(x)))"


SNIPPET = "CASE WHEN length(chunk_text) > 500 THEN left(chunk_text, 500) || '...' ELSE chunk_text END"


def rerank_sql(source: str) -> str:
    """Overlap scores, the 2k buffer, the threshold and the diversity cap over candidates (query_id, chunk_id, doc_id, complexity)."""
    return f"""qw AS (SELECT item_id AS query_id, {sql_low_words('text')} AS q FROM benchmark),
    cw AS (SELECT chunk_id, {sql_low_words(SNIPPET)} AS w FROM chunks),
    ov AS (SELECT c.*, round(len(list_intersect(q, w)) / len(q), 6) AS overlap FROM {source} c JOIN qw USING (query_id) JOIN cw USING (chunk_id)),
    rk AS (SELECT * FROM (SELECT ov.*, keep_k, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_id) AS r FROM ov JOIN sizes USING (complexity)) WHERE r <= keep_k * 2 AND overlap >= 0.3),
    fl AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY r) AS within, count(*) OVER (PARTITION BY query_id) AS total FROM rk),
    pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (total > keep_k AND within > greatest(2, floor(keep_k * 0.4)))::INTEGER, r) AS position FROM fl),
    reranked AS (SELECT * FROM pl WHERE position <= keep_k OR total <= keep_k)"""


@query(
    "r7_rerank",
    f"""WITH {BM25_CTE}, {SIZES}, lv AS (SELECT item_id AS query_id, {LEVEL_SQL} AS complexity FROM benchmark), cands AS (SELECT b.*, complexity FROM bm25 b JOIN lv USING (query_id) WHERE rank <= 50),
    {rerank_sql('cands')} SELECT query_id, chunk_id, overlap AS score, position FROM reranked""",
)
def r7(t):
    c = materialize(chunks(t), "chunks")
    hits = bm25_search(build_bm25(c), benchmark_queries(t), 50).join(leveled_queries(t), "query_id")
    return rt.rerank(rt.populate_text(hits, c)).select("query_id", "chunk_id", "score", "position")


@query(
    "f41_rerank_metadata",
    f"""WITH {BM25_CTE}, {SIZES}, lv AS (SELECT item_id AS query_id, {LEVEL_SQL} AS complexity FROM benchmark), cands AS (SELECT b.*, complexity FROM bm25 b JOIN lv USING (query_id) WHERE rank <= 50),
    {rerank_sql('cands')} SELECT query_id, chunk_id, score AS original_confidence, 'bm25_reranked' AS source, overlap AS confidence FROM reranked""",
)
def f41(t):
    c = materialize(chunks(t), "chunks")
    hits = bm25_search(build_bm25(c), benchmark_queries(t), 50).join(leveled_queries(t), "query_id")
    return rt.rerank(rt.populate_text(hits, c)).select("query_id", "chunk_id", "original_confidence", "source", "confidence")


def hybrid_sql(bm25: str = "true", dense: str = "true", after_dense: str = "true", per_doc: int = 1_000_000, c: int = 60, sparse: str = "SELECT query_id, chunk_id, doc_id, doc_type, score FROM scored WHERE score > 0") -> str:
    """The whole chain; filters of either branch (``dense`` before the 50 nearest are taken), the hits of a document, the fusion's constant."""
    return f"""WITH {BM25_CTE}, {SIZES}, lv AS (SELECT item_id AS query_id, {LEVEL_SQL} AS complexity, {sql_letters('text')} AS qv FROM benchmark),
    cv AS (SELECT chunk_id, doc_id, doc_type, {sql_letters('chunk_text')} AS cv FROM chunks WHERE {dense}),
    dn AS (SELECT query_id, complexity, chunk_id, doc_id, CASE WHEN list_sum(cv) = 0 OR list_sum(qv) = 0 THEN 0 ELSE round(list_cosine_similarity(qv, cv), 6) END AS score FROM lv, cv),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn WHERE {after_dense}),
    sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS all_rank FROM ({sparse})) WHERE all_rank <= 50),
    sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sp WHERE {bm25}),
    br AS (SELECT query_id, complexity, chunk_id, doc_id, rank, 0.4 AS w FROM sr JOIN lv USING (query_id) UNION ALL SELECT query_id, complexity, chunk_id, doc_id, rank, 0.6 FROM dr),
    every AS (SELECT query_id, complexity, chunk_id, doc_id, round(sum(w / ({c} + rank)), 9) AS fusion FROM br JOIN sizes USING (complexity) WHERE rank <= fetch_k GROUP BY ALL),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY fusion DESC, chunk_id) AS of_doc FROM every) WHERE of_doc <= {per_doc}),
    {rerank_sql('fused')},
    par AS (SELECT r.*, d.text AS body, length(d.text) // 4 AS est FROM reranked r JOIN documents d USING (doc_id)),
    us AS (SELECT *, coalesce(sum(least(est, 500)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM par)
    SELECT query_id, chunk_id, doc_id, position AS rank, overlap AS score, est AS est_tokens, md5(left(body, 2000)) AS content_md5
    FROM (SELECT *, max((used + est > 8000)::INTEGER) OVER (PARTITION BY query_id ORDER BY position) AS o FROM us) WHERE o = 0"""


@query("r6_hybrid_search", hybrid_sql())
def r6(t):
    return hybrid_rows(t)


def hybrid_rows(t, sparse=None, **options):
    c = materialize(chunks(t), "chunks")
    q = leveled_queries(t)
    vectors = q.select("query_id", letter_vector("query").alias("embedding"))
    types = options.get("doc_types")  # the search of the vectors must not spend its hits on types that are left out
    index = chunk_vectors(c if types is None else c.where(F.col("doc_type").isin(types)))
    dense = vector_search(index, vectors, 50, dim=26).withColumnRenamed("item_id", "chunk_id")
    dense = dense.join(c.select("chunk_id", "doc_id", "doc_type"), "chunk_id")
    none = F.lit(None).cast("string")
    parents = t.documents.select("doc_id", "text", F.col("source").alias("title"), none.alias("chapter"), none.alias("canonical_citation"))
    out = rt.hybrid_search(q, sparse(t, c, q) if sparse else build_bm25(c), dense, c, parents, **options)
    return out.select("query_id", "chunk_id", "doc_id", "rank", "score", "est_tokens", F.md5("content").alias("content_md5"))


@query("r6_hybrid_options", hybrid_sql(bm25="doc_type IN ('act', 'si') AND least(score, 1.0) >= 0.9", dense="doc_type IN ('act', 'si')", after_dense="score >= 0.9", per_doc=1, c=20))
def r6_options(t):
    """Two document types, hits of at least 0.9, one hit of a document, another constant of the fusion."""
    return hybrid_rows(t, doc_types=["act", "si"], min_score=0.9, max_per_doc=1, rrf_k=20)


def longest_chunks(t, c, q):
    """Another search in place of the sparse one: chunks by length, the same for every query."""
    best = top_k(c.select("chunk_id", "doc_id", "doc_type", F.length("chunk_text").cast("double").alias("score"), F.lit(1).alias("_one")), 50, ["_one"], [F.desc("score"), F.asc("chunk_id")], "_r")
    return q.select("query_id", F.lit(1).alias("_one")).join(best, "_one").drop("_one", "_r")


@query("r6_foreign_branch", hybrid_sql(sparse="SELECT item_id AS query_id, chunk_id, doc_id, doc_type, length(chunk_text)::DOUBLE AS score FROM benchmark, (SELECT * FROM chunks ORDER BY length(chunk_text) DESC, chunk_id LIMIT 50)"))
def r6_foreign(t):
    return hybrid_rows(t, sparse=longest_chunks)


@query(
    "r8_search_confidence",
    f"""WITH {BM25_CTE}, w AS (SELECT *, least(score, 1.0) AS c, CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0.1 END AS w FROM bm25 WHERE rank <= 20)
    SELECT query_id, CASE WHEN count(*) = 1 THEN max(c) ELSE round(sum(c * w) / sum(w), 3) END::DOUBLE AS search_confidence FROM w GROUP BY 1""",
)
def r8(t):
    return search_confidence(benchmark_hits(t, 20))


@query("r9_cache_lookup", f"WITH {TWO_LEVEL_CTE} SELECT label AS user_type, hit_type, count(*) AS n FROM lookups JOIN embeddings ON vec_id = query_id GROUP BY ALL")
def r9(t):
    return lookups(t).groupBy("user_type", "hit_type").agg(F.count("*").alias("n"))


@query(
    "r10_section_lookup",
    f"""WITH {ENTITY_CTE}, refs AS (SELECT o_orderkey AS chunk_id, lower(o_orderpriority) AS title, o_custkey || 'A' AS section FROM orders)
    SELECT query_id, chunk_id, rank FROM (SELECT c_custkey AS query_id, chunk_id, row_number() OVER (PARTITION BY c_custkey ORDER BY chunk_id) AS rank FROM customer JOIN refs ON section = c_custkey || 'A' AND title = '1-urgent') WHERE rank <= 6""",
)
def r10(t):
    from docketlake.functions.entities import extract_entities

    refs = F.try_element_at(extract_entities("chunk_text"), F.lit("statute_refs"))
    c = legal_chunks(t).join(t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("title")), "chunk_id")
    wanted = t.customer.select(
        F.col("c_custkey").alias("query_id"), F.lit("1-Urgent").alias("title"), F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("a")).alias("section"))
    return rt.section_lookup(c.withColumn("sections", refs), wanted).select("query_id", "chunk_id", "rank")


@query("f6_chunk_ids", f"SELECT doc_id, {sql_chunk_id('doc_id', 'source', '0', 'n_chars', 'text')} AS chunk_id FROM documents")
def f6(t):
    return t.documents.select("doc_id", ids.chunk_id("doc_id", "source", F.lit(0), "n_chars", "text").alias("chunk_id"))


@query("f28_cache_ttl", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 7200 WHEN 'assistant' THEN 900 ELSE 3600 END AS ttl FROM conversations")
def f28(t):
    level = F.when(F.col("role") == "user", "simple").when(F.col("role") == "assistant", "expert").otherwise("unknown")
    return t.conversations.select("conv_id", "turn", complexity_value("ttl", level).alias("ttl"))


@query(
    "d5_own_tokenizer",
    f"WITH {CHUNK_CTE}, tk AS (SELECT chunk_id, unnest({sql_words('lower(chunk_text)')}) AS term FROM chunks) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS occurrences FROM tk GROUP BY 1",
)
def d5(t):
    c = chunks(t).withColumn("tokens", tx.words(F.lower("chunk_text")))
    p = build_bm25(c, tokens="tokens").postings
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("d6_split_text_function", f"WITH RECURSIVE {SPLIT_CTE} SELECT doc_id, sub_index, length(part) AS chars FROM parts")
def d6(t):
    register_functions(t.spark)
    t.documents.createOrReplaceTempView("docketlake_documents")
    return t.spark.sql("SELECT d.doc_id, s.sub_index, length(s.part) AS chars FROM docketlake_documents d, LATERAL split_text(d.text, 300) s")


@query("d6_split_table_function", f"WITH RECURSIVE {SPLIT_CTE} SELECT doc_id::VARCHAR AS id, sub_index, length(part) AS chars, md5(part) AS part_md5 FROM parts")
def d6_table(t):
    register_functions(t.spark)
    t.documents.createOrReplaceTempView("docketlake_documents")
    return t.spark.sql(
        "SELECT id, sub_index, length(part) AS chars, md5(part) AS part_md5 FROM split_table(TABLE(SELECT string(doc_id) AS id, text, 300 AS max_tokens FROM docketlake_documents) PARTITION BY id)")
