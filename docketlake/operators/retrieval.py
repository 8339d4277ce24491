"""Composite retrieval: parent expansion, context budgets, reranking, hybrid search, extractive answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketlake.constants import (
    AUTHORITY_TAGS,
    COMPLEXITY,
    CONTEXT_CHARS_PER_DOC,
    CONTEXT_TOKENS,
    CONTEXT_TOKENS_PER_DOC,
    DEFAULT_AUTHORITY_TAG,
    MIN_RERANK_SCORE,
    RERANK_TEXT_CHARS,
    RRF_C,
    SENTENCE_WORDS,
)
from docketlake.functions.query import reformulations
from docketlake.functions.text import estimate_tokens, strip, word_count, words
from docketlake.operators.bm25 import SparseIndex, bm25_search
from docketlake.operators.fusion import (
    adaptive_top_k,
    complexity_value,
    diversify,
    merge_best,
    rank_fusion,
    top_k,
    union_branches,
)
from docketlake.operators.reduction import only_asked
from docketlake.operators.vectors import embed, vector_search
from docketlake.session import materialize

#: Joins that bring texts. Spark estimates a text by its file or, if computed, by a constant, and would broadcast gigabytes.
TEXT_JOIN = "merge"


def populate_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk text by id, joined after the hits are selected.

    The hits are written once; their ids then thin out the chunks before a text is shuffled.
    """
    hits = hits if hasattr(hits, "scratch_path") else materialize(hits, "hits")
    texts = only_asked(chunks.select("chunk_id", "chunk_text"), hits.select("chunk_id"), "chunk_id")
    return hits.join(texts.hint(TEXT_JOIN), "chunk_id", "left")


def expand_to_parents(
    hits: DataFrame, parents: DataFrame, clamp: bool = False, asked: DataFrame | None = None,
    view: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Replace chunk text by the parent's text; a hit without parent keeps its own.

    ``parents``: doc_id, text, title, chapter, canonical_citation. ``clamp`` lifts confidence to [0.7, 1]. ``asked`` is a narrow
    table with at least the doc_ids of the hits, by which the parents are thinned out before a text is shuffled; without it
    the hits are written first. ``view`` maps a text to what is wanted of it, such as its digest; parent and chunk texts then
    pass the join, and are returned, as that.
    """
    view = view or (lambda text: text)
    if asked is None:
        hits = asked = hits if hasattr(hits, "scratch_path") else materialize(hits, "hits")
    p = only_asked(parents, asked.select("doc_id"), "doc_id").select(
        "doc_id",
        view(F.coalesce("text", F.lit(""))).alias("_parent_text"), F.coalesce(F.length("text"), F.lit(0)).alias("_parent_length"),
        F.col("title"), F.col("chapter"), F.col("canonical_citation"),
        F.lit(True).alias("_found"),
    )
    joined = hits.withColumn("chunk_text", view(F.col("chunk_text"))).join(p.hint(TEXT_JOIN), "doc_id", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    out = (
        joined.withColumn("expanded_to_parent", found)
        .withColumn("original_chunk_text", F.col("chunk_text"))
        .withColumn("parent_doc_length", F.when(found, F.col("_parent_length")).otherwise(0))
        .withColumn("chunk_text", F.when(found, F.col("_parent_text")).otherwise(F.col("chunk_text")))
    )
    if clamp:
        out = out.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.7), F.col("confidence"))))
    return out.drop("_parent_text", "_parent_length", "_found")


def within_context_budget(
    ranked: DataFrame, content: str = "content", max_tokens: int = CONTEXT_TOKENS, rank: str = "rank"
) -> DataFrame:
    """Leading hits per query until one would exceed the budget; a document counts at most 500 tokens.

    Hits without content (no parent) are skipped and use nothing. The content is measured and cut before the hits are dealt
    to their queries; where it is a column of the parents, ``within_token_budget`` needs none of it.
    """
    usable = ranked.withColumn("est_tokens", estimate_tokens(content)).withColumn("content", leading_content(content))
    return within_token_budget(usable, max_tokens, rank)


def leading_content(content: Column | str) -> Column:
    """What a context shows of a document."""
    return F.substring(content, 1, CONTEXT_CHARS_PER_DOC)


def within_token_budget(ranked: DataFrame, max_tokens: int = CONTEXT_TOKENS, rank: str = "rank") -> DataFrame:
    """Leading hits per query by their ``est_tokens``; hits where it is null have no content and are skipped."""
    usable = ranked.where(F.col("est_tokens").isNotNull())
    before = W.partitionBy("query_id").orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("query_id").orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    used = F.coalesce(F.sum(F.least("est_tokens", F.lit(CONTEXT_TOKENS_PER_DOC))).over(before), F.lit(0))
    return (
        usable.withColumn("used_before", used)
        .withColumn("_over", F.max((F.col("used_before") + F.col("est_tokens") > max_tokens).cast("int")).over(upto))
        .where(F.col("_over") == 0)
        .drop("_over")
    )


def context_summary(bundle: DataFrame) -> DataFrame:
    """Authoritative sources and counted tokens per query."""
    return bundle.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.coalesce("canonical_citation", "title"))), "; ").alias("sources"),
        F.sum(F.least("est_tokens", F.lit(CONTEXT_TOKENS_PER_DOC))).alias("context_tokens"),
        F.count("*").alias("documents"),
    )


def authority_tag(doc_type: Column | str) -> Column:
    c = F.col(doc_type) if isinstance(doc_type, str) else doc_type
    tags = F.create_map(*[F.lit(x) for pair in AUTHORITY_TAGS.items() for x in pair])
    return F.coalesce(F.try_element_at(tags, c), F.lit(DEFAULT_AUTHORITY_TAG))


def format_context(bundle: DataFrame, rank: str = "rank") -> DataFrame:
    """One text per query: numbered sources in rank order with authority tags."""
    entry = F.concat(
        F.lit("\n"), authority_tag("doc_type"), F.lit(" Source "), F.col("_n").cast("string"), F.lit(": "),
        F.coalesce("title", F.lit("Legal Document")), F.lit("\nDoc Key: "),
        F.coalesce(F.col("doc_key").cast("string"), F.concat(F.lit("document_"), F.col("_n"))),
        F.lit("\nAuthority Level: "), F.upper(F.coalesce("authority_level", F.lit("medium"))),
        F.lit("\n\nContent:\n"), F.coalesce("content", F.lit("")), F.lit("\n\n---"),
    )
    numbered = bundle.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(rank)))
    return numbered.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_n", entry.alias("e")))), lambda x: x["e"]), "\n"
        ).alias("context")
    )


# --- reranking -------------------------------------------------------------


def token_overlap(query: Column | str, text: Column | str) -> Column:
    """Default scorer: share of the query's distinct words found in the text."""
    q = F.array_distinct(F.transform(words(query), F.lower))
    d = F.array_distinct(F.transform(words(text), F.lower))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(F.lit(0.0))


def rerank_text(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(
        F.length(c) > RERANK_TEXT_CHARS, F.concat(F.substring(c, 1, RERANK_TEXT_CHARS), F.lit("..."))
    ).otherwise(c)


def rerank(hits: DataFrame, scorer=token_overlap, text: str = "chunk_text", complexity: str = "complexity") -> DataFrame:
    """Score (query, text) pairs, keep twice the target, drop scores under 0.3, then diversify to the target.

    ``scorer(query_column, text_column)`` returns a Column; a pandas UDF around a model fits as well.
    """
    scored = (
        hits.withColumn("original_confidence", F.col("score"))
        .withColumn("score", F.round(scorer(F.col("query"), rerank_text(text)), 6))
        .withColumn("source", F.concat(F.coalesce("source", F.lit("unknown")), F.lit("_reranked")))
        .withColumn("confidence", F.col("score"))
    )
    target = complexity_value("keep", complexity)
    most = 2 * max(row[2] for row in COMPLEXITY)
    ranked = top_k(scored, most, ["query_id"], [F.desc("score"), F.asc("chunk_id")]).where(F.col("rank") <= target * 2)
    good = ranked.where(F.col("score") >= MIN_RERANK_SCORE)
    return diversify(good, target)


# --- hybrid search ---------------------------------------------------------


def query_variants(queries: DataFrame, text: str = "query", limit: int = 4) -> DataFrame:
    """One row per reformulation of every query."""
    return queries.select(
        "query_id", F.posexplode_outer(reformulations(text, limit)).alias("variant_idx", "variant")
    ).where(F.col("variant").isNotNull())


def multi_variant_search(
    index: DataFrame, queries: DataFrame, fn, dim: int, k: int = 20, keep: Column | None = None
) -> DataFrame:
    """Embed every reformulation and search with each; hits stay keyed by query and variant."""
    variants = query_variants(queries)
    keyed = variants.withColumn("_key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant_idx").cast("string")))
    vectors = embed(keyed.select(F.col("_key").alias("query_id"), "variant"), fn, dim, text="variant")
    hits = vector_search(index, vectors.select("query_id", "embedding"), k, keep=keep, dim=dim)
    return hits.withColumnRenamed("query_id", "_key").join(keyed.drop("variant"), "_key").drop("_key")


_HIT = ["query_id", "chunk_id", "doc_id", "doc_type", "score"]


def branch_hits(
    hits: DataFrame, queries: DataFrame, chunks: DataFrame, doc_types: list[str] | None = None, min_score: float | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Hits of one search (query_id, chunk_id, doc_id, doc_type, score) that may be fused, limited per complexity, with ``rank``.

    ``doc_types`` keeps these types; ``min_score`` drops hits of less confidence (score, at most 1); ``as_of`` (ISO date) drops chunks
    whose date_context lies after it, undated ones stay.
    """
    if doc_types is not None:
        hits = hits.where(F.col("doc_type").isin(doc_types))
    if min_score is not None:
        hits = hits.where(F.least("score", F.lit(1.0)) >= min_score)
    if as_of is not None:
        late = chunks.where(F.to_date("date_context") > F.lit(as_of).cast("date")).select("chunk_id")
        hits = hits.join(late, "chunk_id", "left_anti")
    return adaptive_top_k(hits.select(*_HIT).join(queries.select("query_id", "complexity"), "query_id"), "retrieve")


def limit_per_document(fused: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits of each document and query; ties go to the smaller chunk_id."""
    return top_k(fused, limit, ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_id")], "_within").drop("_within")


def hybrid_search(
    queries: DataFrame, sparse: SparseIndex | DataFrame, dense_hits: DataFrame, chunks: DataFrame, parents: DataFrame,
    fusion: str = "rrf", scorer=token_overlap, doc_types: list[str] | None = None, min_score: float | None = None,
    as_of: str | None = None, max_per_doc: int | None = None, rrf_k: int = RRF_C,
) -> DataFrame:
    """queries(query_id, query, complexity) to a context bundle per query.

    Sparse and dense hits are limited per complexity, fused ("rrf" with its constant ``rrf_k``, or "max"), given their text,
    reranked, expanded to parents and cut to the context budget. Texts are joined only for survivors. ``sparse`` is an index
    or the hits of any other search; dense hits may name a query several times, once for each variant of it, of which the
    best counts. ``doc_types``, ``min_score`` and ``as_of`` filter the hits of both searches before they are limited;
    ``max_per_doc`` limits the fused hits of a document.
    """
    lexical = bm25_search(sparse, queries, 50) if isinstance(sparse, SparseIndex) else sparse
    options = (queries, chunks, doc_types, min_score, as_of)
    dense = merge_best(dense_hits.select(*_HIT))
    both = union_branches(bm25=branch_hits(lexical, *options), dense=branch_hits(dense, *options))
    facts = both.groupBy("query_id", "chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("doc_type").alias("doc_type"))
    if fusion == "max":
        best = both.withColumn("score", F.least("score", F.lit(1.0)))
        fused = merge_best(best, arrival=[(F.col("source") == "dense").cast("int")]).select("query_id", "chunk_id", "score", "source")
    else:
        fused = rank_fusion(both, c=rrf_k, rank="rank").withColumnRenamed("sources", "source")
    candidates = fused.join(facts, ["query_id", "chunk_id"])
    if max_per_doc is not None:
        candidates = limit_per_document(candidates, max_per_doc)
    candidates = materialize(candidates.join(queries.select("query_id", "query", "complexity"), "query_id"), "candidates")
    ranked = rerank(populate_text(candidates, chunks), scorer)
    ranked = ranked.drop("rank").withColumnRenamed("position", "rank")
    expanded = expand_to_parents(ranked, parents, asked=candidates)
    return within_context_budget(
        expanded.withColumn("_body", F.when(F.col("expanded_to_parent"), F.col("chunk_text"))), "_body"
    )


def section_lookup(chunks: DataFrame, wanted: DataFrame, k: int = 6) -> DataFrame:
    """Chunks of a titled document that mention a section: wanted(query_id, title, section)."""
    refs = chunks.select("chunk_id", F.lower("title").alias("title_key"), F.explode("sections").alias("section"))
    keys = wanted.select("query_id", F.lower("title").alias("title_key"), F.upper(F.trim("section")).alias("section"))
    hits = refs.withColumn("section", F.upper("section")).join(keys, ["title_key", "section"]).dropDuplicates(["query_id", "chunk_id"])
    return top_k(hits, k, ["query_id"], [F.asc("chunk_id")])


# --- extractive answers ----------------------------------------------------


def sentence_rows(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Sentences longer than 10 characters with their position and score."""
    pieces = F.transform(F.split(text, "[.!?]+"), strip)
    rows = df.select(*keys, F.posexplode_outer(pieces).alias("pos", "sentence")).where(F.length("sentence") > 10)
    n = word_count("sentence")
    vocabulary = F.array(*[F.lit(w) for w in SENTENCE_WORDS])
    hits = F.size(F.filter(words(F.lower("sentence")), lambda w: F.array_contains(vocabulary, w)))
    band = F.when((n >= 5) & (n <= 25), 2).when(n > 25, 1).otherwise(0)
    return rows.withColumn("sentence_score", band + hits)


def key_sentences(df: DataFrame, text: str, keys: list[str], k: int = 3) -> DataFrame:
    return top_k(sentence_rows(df, text, keys), k, keys, [F.desc("sentence_score"), F.asc("pos")], "sentence_rank")


def extractive_answers(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """tldr, key points and citations from the three best hits of every query."""
    top = ranked.where(F.col(rank) <= 3)
    texts = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(rank, "chunk_text", "title", "score"))).alias("_h")
    ).select(
        "query_id",
        F.concat(F.lit(" "), F.array_join(F.transform("_h", lambda h: h["chunk_text"]), " ")).alias("_text"),
        F.array_join(
            F.transform("_h", lambda h: F.concat(h["title"], F.lit(" ("), F.format_number(h["score"], 3), F.lit(")"))), "; "
        ).alias("citations"),
    )
    best = key_sentences(texts, "_text", ["query_id", "citations"], 5)

    def shorten(s):
        w = words(s)
        return F.when(F.size(w) > 25, F.concat(F.array_join(F.slice(w, 1, 25), " "), F.lit("..."))).otherwise(s)

    lists = best.groupBy("query_id", "citations").agg(
        F.array_sort(F.collect_list(F.struct("sentence_rank", "sentence"))).alias("_s")
    )
    tldr = F.array_join(F.transform(F.slice("_s", 1, 2), lambda s: s["sentence"]), ". ")
    return lists.select(
        "query_id",
        F.when(F.length(tldr) > 220, F.concat(F.substring(tldr, 1, 217), F.lit("..."))).otherwise(tldr).alias("tldr"),
        F.array_join(F.transform("_s", lambda s: shorten(s["sentence"])), " | ").alias("key_points"),
        "citations",
    )
