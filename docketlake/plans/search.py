"""Sparse and dense search, fusion and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.operators.bm25 import bm25_search, build_bm25
from docketlake.operators.vector_index import build_vector_index, stored_exact_search, stored_search
from docketlake.operators.vectors import approximate_search, cosine, nearest_above, vector_search
from docketlake.plans.common import CHUNK_CTE, chunks, sql_tokens
from docketlake.plans.registry import query

INDEX_CTE = f"""{CHUNK_CTE},
toks AS (SELECT chunk_id, doc_id, doc_type, {sql_tokens('chunk_text')} AS ts FROM chunks),
docs AS (SELECT chunk_id, len(ts) AS dl FROM toks),
posts AS (SELECT chunk_id, doc_id, doc_type, term, count(*) AS tf FROM (SELECT chunk_id, doc_id, doc_type, unnest(ts) AS term FROM toks) GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, avg(dl) AS avgdl FROM docs),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM dfs, corpus),
idfs AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""

BM25_CTE = f"""{INDEX_CTE},
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, doc_id, doc_type,
    round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN idfs USING (term) JOIN posts USING (term) JOIN docs USING (chunk_id), corpus GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0)"""


def benchmark_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def benchmark_hits(t, k: int = 50):
    return bm25_search(build_bm25(chunks(t)), benchmark_queries(t), k)


@query(
    "r1_bm25_postings",
    f"""WITH {INDEX_CTE} SELECT term, chunk_id, tf, dl FROM posts JOIN docs USING (chunk_id)""",
)
def r1(t):
    index = build_bm25(chunks(t))
    return index.named_postings().select("term", "chunk_id", "tf", "dl")


@query("a7_corpus_stats", f"""WITH {INDEX_CTE} SELECT n_docs, n_tokens, round(avgdl, 6) AS avgdl,
    (SELECT count(*) FROM idfs) AS n_terms, (SELECT max(df) FROM idfs) AS max_df,
    (SELECT round(avg(idf), 6) FROM idfs) AS avg_idf FROM corpus""")
def a7(t):
    index = build_bm25(chunks(t))
    terms = index.term_stats().agg(
        F.count("*").alias("n_terms"), F.max("df").alias("max_df"), F.round(F.avg("idf"), 6).alias("avg_idf")
    )
    return index.corpus_stats().select(
        "n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"),
        *[terms.select(c).scalar().alias(c) for c in ("n_terms", "max_df", "avg_idf")],
    )


@query(
    "r2_bm25_search",
    f"""WITH {BM25_CTE} SELECT query_id, chunk_id, doc_id, rank, score, least(score, 1.0) AS confidence
    FROM bm25 WHERE rank <= 50""",
)
def r2(t):
    return benchmark_hits(t).select("query_id", "chunk_id", "doc_id", "rank", "score", "confidence")


# --- dense -----------------------------------------------------------------

CENTROID_CTE = """
dims AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
cent AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM dims GROUP BY label),
dense AS (SELECT query_id, vec_id AS item_id, label, round(list_cosine_similarity(c, embedding::DOUBLE[]), 6) AS score FROM cent, embeddings)"""


def vector_index(t):
    return t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding", "label")


def label_centroids(t):
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v")).select(
        F.col("label").alias("query_id"), F.transform("v", lambda p: p["m"]).alias("embedding")
    )


@query(
    "r5_vector_search",
    f"""WITH {CENTROID_CTE} SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense) WHERE rank <= 20""",
)
def r5(t):
    return vector_search(vector_index(t), label_centroids(t), 20, dim=64)


@query(
    "p13_filtered_vector_search",
    f"""WITH {CENTROID_CTE} SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense WHERE label IN (1, 3, 5, 7)) WHERE rank <= 10""",
)
def p13(t):
    return vector_search(vector_index(t), label_centroids(t), 10, keep=F.col("label").isin(1, 3, 5, 7), dim=64)


@query(
    "r5_tiled_vector_search",
    f"""WITH {CENTROID_CTE} SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense) WHERE rank <= 5""",
)
def r5_tiled(t):
    return vector_search(vector_index(t), label_centroids(t), 5, block_rows=256)


@query("r5_approximate_vector_search")
def r5_approximate(t):
    return approximate_search(vector_index(t), label_centroids(t), 10, cells=16, nprobe=14)


@query(
    "r5_all_cells_vector_search",
    f"""WITH {CENTROID_CTE} SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense) WHERE rank <= 10""",
)
def r5_all_cells(t):
    return approximate_search(vector_index(t), label_centroids(t), 10, cells=16, nprobe=16)


@query("r5_stored_vector_search")
def r5_stored(t):
    return stored_search(build_vector_index(vector_index(t), cells=16), label_centroids(t), 10)


@query(
    "r5_stored_exact_search",
    f"""WITH {CENTROID_CTE} SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense) WHERE rank <= 10""",
)
def r5_stored_exact(t):
    return stored_exact_search(build_vector_index(vector_index(t), cells=16), label_centroids(t), 10)


@query(
    "f29_cosine",
    f"""WITH {CENTROID_CTE} SELECT item_id, score AS similarity FROM dense WHERE query_id = label""",
)
def f29(t):
    own = label_centroids(t).select(F.col("query_id").alias("label"), F.col("embedding").alias("centroid"))
    return vector_index(t).join(own, "label").select(
        "item_id", F.round(cosine("embedding", "centroid"), 6).alias("similarity")
    )


REQUEST_CTE = """
dims AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
cent AS (SELECT label, list(m ORDER BY i) AS c FROM dims GROUP BY label),
req AS (SELECT vec_id AS query_id, label, list_transform(embedding, lambda x, i: x::DOUBLE + 2.0 * c[i]) AS v FROM embeddings JOIN cent USING (label)),
pairs AS (SELECT query_id, vec_id AS item_id, label, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM req JOIN embeddings USING (label)),
semantic AS (SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM pairs) WHERE r = 1 AND score >= 0.9)"""


def cache_requests(t):
    """Every vector moved towards the mean of its label: near repeats of cached questions."""
    own = label_centroids(t).select(F.col("query_id").alias("label"), F.col("embedding").alias("centroid"))
    return t.embeddings.join(own, "label").select(
        F.col("vec_id").alias("query_id"), "label",
        F.zip_with("embedding", "centroid", lambda x, y: x.cast("double") + F.lit(2.0) * y).alias("embedding"),
    )


@query("j9_semantic_cache", f"WITH {REQUEST_CTE} SELECT query_id, item_id, score FROM semantic")
def j9(t):
    return nearest_above(vector_index(t), cache_requests(t), 0.9, by="label", cells=16)
