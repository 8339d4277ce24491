"""BM25, vectors and selection against brute force."""

import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
from docketlake.operators import bm25, fusion as fu, retrieval as rt, vectors as ve

FOLDER = "/root/testdata/sf0.001"
CORPUS = {
    "c1": "lawful strike procedure strike", "c2": "minimum wage section 5", "c3": "strike notice wage wage", "c4": "unrelated text here strike",
    "c5": "", "c6": "strike wage",
}
QUERIES = {"q1": "strike strike wage", "q2": "procedure section 5", "q3": "missing"}


def brute(k1=1.5, b=0.75):
    docs = {c: t.replace("section 5", "section 5").split() for c, t in CORPUS.items()}
    docs = {c: [w for w in ws if len(w) > 1] for c, ws in docs.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ws in docs.values() for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: (0.25 * mean if r < 0 else r) for w, r in raw.items()}
    out = {}
    for q, text in QUERIES.items():
        for c, ws in docs.items():
            tf = Counter(ws)
            s = sum(idf.get(w, 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / avgdl)) for w in text.split() if len(w) > 1)
            if round(s, 6) > 0:
                out[q, c] = round(s, 6)
    return out


@pytest.mark.parametrize("bits", [0, 1, 6])
def test_bm25_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(bm25, "RANGE_BITS", bits)
    chunks = spark.createDataFrame([(c, "d" + c, "act", t) for c, t in CORPUS.items()], "chunk_id string, doc_id string, doc_type string, chunk_text string")
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    hits = bm25.bm25_search(bm25.build_bm25(chunks), queries, 10).collect()
    got = {(h.query_id, h.chunk_id): h.score for h in hits}
    want = brute()
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {h.doc_id for h in hits if h.chunk_id == "c1"} == {"dc1"}


def test_index_round_trip_and_ties(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "d", "act", "same words again") for i in range(9)] + [("z", "d", "act", "other thing")],
                                   "chunk_id string, doc_id string, doc_type string, chunk_text string")
    queries = spark.createDataFrame([("q", "other"), ("r", "thing other")], "query_id string, query string")
    bm25.build_bm25(chunks, path=str(tmp_path))
    saved = bm25.SparseIndex.load(spark, str(tmp_path))
    assert {h.chunk_id for h in bm25.bm25_search(saved, queries, 3).collect()} == {"z"}
    more = spark.createDataFrame([("q", "same")], "query_id string, query string")
    two = spark.createDataFrame([(f"c{i}", "d", "act", "same words") for i in range(4)] + [(f"x{i}", "d", "act", f"w{i} v{i}") for i in range(9)],
                                "chunk_id string, doc_id string, doc_type string, chunk_text string")
    assert [h.chunk_id for h in bm25.bm25_search(bm25.build_bm25(two), more, 2).orderBy("rank").collect()] == ["c0", "c1"]


def test_pruned_search_equals_search_of_all_ranges(spark, monkeypatch):
    """Frequent words in every range, rare ones in few: pruning skips ranges and loses nothing, also at ties and for weights below zero."""
    monkeypatch.setattr(bm25, "RANGE_BITS", 2)
    monkeypatch.setattr(bm25, "PART_BITS", 3)
    rng = np.random.default_rng(2)
    texts = [" ".join(["hot"] * (i % 3) + ["half"] * (i % 2) + [f"w{x}" for x in rng.zipf(1.4, rng.integers(1, 30)) if x < 400]) for i in range(900)]
    rows = [(f"c{i:04d}", f"d{i // 7}", "act", t) for i, t in enumerate(texts)] + [("none", "d", "act", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, doc_type string, chunk_text string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(["hot", "half", *(f"w{x}" for x in range(1, 60))], 6))) for i in range(25)] + [("empty", ""), ("null", None)], "query_id string, query string")
    index = bm25.build_bm25(chunks)
    n_docs, *_ = index.corpus_stats().first()
    assert n_docs == 901 and index.blocks.select("bucket").distinct().count() > 8
    pruned = {(h.query_id, h.rank): (h.chunk_id, h.score) for h in bm25.bm25_search(index, queries, 7).collect()}
    every = {(h.query_id, h.rank): (h.chunk_id, h.score) for h in bm25.bm25_search(index, queries, 7, seeds=900).collect()}
    assert pruned == every and len({q for q, _ in pruned}) == 25
    idf = {r.term: r.idf for r in index.term_stats().collect()}
    avgdl, want = index.corpus_stats().first()["avgdl"], {}
    docs = [(c, Counter(w for w in (t or "").split() if len(w) > 1)) for c, _, _, t in rows]
    for q in queries.collect():
        asked = [w for w in (q.query or "").split() if len(w) > 1 and w in idf]
        scores = [(round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * tf.total() / avgdl)) for w in asked), 6), c) for c, tf in docs]
        for r, (s, c) in enumerate(sorted(((s, c) for s, c in scores if s > 0), key=lambda x: (-x[0], x[1]))[:7], 1):
            want[q.query_id, r] = (c, s)
    assert {k: v[0] for k, v in pruned.items()} == {k: v[0] for k, v in want.items()} and all(abs(pruned[k][1] - want[k][1]) < 2e-6 for k in want)


def test_search_reads_the_folders_of_the_query_terms(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "act", f"word{i} other{i}") for i in range(300)], "chunk_id string, doc_id string, doc_type string, chunk_text string")
    hits = bm25.bm25_search(bm25.build_bm25(chunks), spark.createDataFrame([("q", "word7")], "query_id string, query string"), 3)
    assert [h.chunk_id for h in hits.collect()] == ["c7"]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^]]*bucket#\d+[^]]*)\]", plan)
    assert filters and all(" IN (" in f or " = " in f for f in filters)


def test_postings_and_scores_are_not_shuffled_one_by_one(spark, monkeypatch):
    """Blocks are made where the chunks lie, also across slices and batches; a search sends blocks and the best of a tile."""
    monkeypatch.setattr(bm25, "SLICE", 8)
    monkeypatch.setattr(bm25, "RANGE_BITS", 3)
    texts = {f"c{i:03d}": " ".join([f"w{i % 7}"] * (i % 3 + 1) + ["all", f"own{i}"]) for i in range(200)}
    chunks = spark.createDataFrame([(c, "d", "act", t) for c, t in texts.items()], "chunk_id string, doc_id string, doc_type string, chunk_text string").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        index = bm25.build_bm25(chunks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((w, c, n, len(t.split())) for c, t in texts.items() for w, n in Counter(t.split()).items())
    assert sorted(tuple(r) for r in index.named_postings().collect()) == want
    assert sorted(tuple(r) for r in index.postings.join(index.doc_stats().select("chunk_no", "chunk_id"), "chunk_no").select("term", "chunk_id", "tf", "dl").collect()) == want
    assert sum(r.n for r in index.blocks.collect()) == len(want)
    twice = index.blocks.groupBy("term", "range").count().where("count > 1").count()
    assert twice == 0
    hits = bm25.bm25_search(index, spark.createDataFrame([("q", "all w3")], "query_id string, query string"), 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and not re.search(r"Generate inline\(posts", plan)
    assert {h.chunk_id for h in hits.collect()} <= {c for c, t in texts.items() if "w3" in t.split()}


def test_an_empty_corpus_gives_no_hits(spark):
    none = spark.createDataFrame([], "chunk_id string, doc_id string, doc_type string, chunk_text string")
    assert bm25.bm25_search(bm25.build_bm25(none), spark.createDataFrame([("q", "word")], "query_id string, query string")).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    index = [(i, [float(x) for x in (hot + 0.05 * rng.normal(size=8) if i % 3 == 0 else rng.normal(size=8))], i % 2) for i in range(300)]
    queries = [(i, [float(x) for x in (hot if i == 0 else rng.normal(size=8))], i % 2) for i in range(12)] + [(99, [0.0] * 8, 0)]
    idx = spark.createDataFrame(index, "item_id int, embedding array<double>, kind int").repartition(5)
    qs = spark.createDataFrame(queries, "query_id int, embedding array<double>, kind int")
    return idx, qs, index, queries


def best(index, queries, k, same=False, floor=None):
    out = {}
    for qid, qv, qk in queries:
        rows = []
        for iid, iv, ik in index:
            if same and ik != qk:
                continue
            n = np.linalg.norm(qv) * np.linalg.norm(iv)
            rows.append((round(float(np.dot(qv, iv) / n), 6) if n else 0.0, iid))
        rows.sort(key=lambda r: (-r[0], r[1]))
        out[qid] = [(i, s) for s, i in rows[:k] if floor is None or s >= floor]
    return {q: r for q, r in out.items() if r}


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.item_id, r.score))
    return {q: sorted(v, key=lambda x: (-x[1], x[0])) for q, v in out.items()}


def test_exact_search_by_scan_and_by_tiles(vectors):
    idx, qs, index, queries = vectors
    want = best(index, queries, 5)
    assert rows(ve.vector_search(idx, qs, 5, dim=8)) == want
    assert rows(ve.vector_search(idx, qs, 5, block_rows=40)) == want
    assert rows(ve.vector_search(idx, qs, 5, by="kind", block_rows=40)) == best(index, queries, 5, same=True)


def test_approximate_with_all_cells_is_exact(vectors):
    idx, qs, index, queries = vectors
    assert rows(ve.approximate_search(idx, qs, 5, cells=6, nprobe=6, block_rows=64)) == best(index, queries, 5)
    some = rows(ve.approximate_search(idx, qs, 5, cells=6, nprobe=2))
    assert all(len(v) <= 5 for v in some.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_registered_approximate_search_finds_nine_of_ten(spark):
    found, every = (entry.queries()[n](spark, FOLDER) for n in ("r5_approximate_vector_search", "r5_vector_search"))
    want = {(r.query_id, r.item_id) for r in every.where("rank <= 10").collect()}
    got = {(r.query_id, r.item_id) for r in found.collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_threshold_search_is_exact(vectors):
    idx, qs, index, queries = vectors
    assert rows(ve.nearest_above(idx, qs, 0.6, by="kind", cells=8, block_rows=32)) == best(index, queries, 1, same=True, floor=0.6)


def test_few_pairs_are_scored_at_many_dimensions(monkeypatch):
    """3,072 dimensions, crowds and strangers, zero vectors: the pairs of brute force, from a twentieth of all products."""
    rng = np.random.default_rng(12)
    crowd = rng.normal(size=(6, 3072))
    items = np.concatenate([crowd[k % 6] + 0.2 * rng.normal(size=3072) for k in range(120)] + [rng.normal(size=3072) for _ in range(1880)]).reshape(-1, 3072)
    queries = np.concatenate([[crowd[k % 6] + 0.25 * rng.normal(size=3072) for k in range(40)], rng.normal(size=(159, 3072)), np.zeros((1, 3072))])
    items, queries = ve._unit(items), ve._unit(queries)
    full, scored = np.round(queries @ items.T, 6), []
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: (scored.append(len(a)), plain(how, a, b))[1])
    at, item, scores = ve.pairs_above(queries, items, 0.9)
    want = np.nonzero(full >= 0.9)
    assert (at.tolist(), item.tolist()) == (want[0].tolist(), want[1].tolist()) and np.allclose(scores, full[want], atol=2e-6) and len(at) > 300
    assert sum(scored) < 0.05 * full.size


def test_embed_failure_policy(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, chunk_text string").coalesce(1)

    def fn(texts):
        if "bad" in texts:
            raise ValueError("no")
        return np.ones((len(texts), 3))

    got = {r.id: (list(r.embedding), r.embedded) for r in ve.embed(df, fn, 3, batch=1, on_error="zeros").collect()}
    assert got == {1: ([1.0] * 3, True), 2: ([0.0] * 3, False)}
    with pytest.raises(Exception):
        ve.embed(df, fn, 3, batch=1).collect()


def test_vectors_leave_a_worker_in_pieces_of_bounded_size():
    class Frame:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("chunk_text", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    run = ve.embed(Frame(), lambda texts: np.array([[len(t)] * 1024 for t in texts]), 1024, batch=30)
    texts = ["x" * (i % 9) for i in range(5000)]
    pieces = list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(5000)), "chunk_text": texts})])))
    assert len(pieces) > 1 and all(p.num_rows * 4096 <= ve.EMBED_BYTES for p in pieces)
    rows = pa.Table.from_batches(pieces)
    assert rows["id"].to_pylist() == list(range(5000)) and all(rows["embedded"].to_pylist())
    assert [v[-1] for v in rows["embedding"].to_pylist()] == [len(t) for t in texts]


def test_diversity_cap_fills_up_in_rank_order(spark):
    ranked = spark.createDataFrame([("q", f"c{i:02}", "A" if i <= 6 else ("B" if i <= 8 else "C"), i) for i in range(1, 11)], "query_id string, chunk_id string, doc_id string, rank int")
    got = [r.chunk_id for r in fu.diversify(ranked, 5).orderBy("position").collect()]
    assert got == ["c01", "c02", "c07", "c08", "c09"]
    few = fu.diversify(ranked.where("rank <= 6"), 5).orderBy("position").collect()
    assert [r.chunk_id for r in few] == ["c01", "c02", "c03", "c04", "c05"]
    assert fu.diversify(ranked.where("rank <= 4"), 5).count() == 4


def test_parent_missing_keeps_chunk(spark):
    hits = spark.createDataFrame([("q", "c1", "d1", "chunk one", 0.2), ("q", "c2", "dX", "chunk two", 0.9)], "query_id string, chunk_id string, doc_id string, chunk_text string, confidence double")
    parents = spark.createDataFrame([("d1", "whole parent", "T", None, None)], "doc_id string, text string, title string, chapter string, canonical_citation string")
    got = {r.chunk_id: r for r in rt.expand_to_parents(hits, parents, clamp=True).collect()}
    assert got["c1"].chunk_text == "whole parent" and got["c1"].confidence == 0.7 and got["c1"].parent_doc_length == 12
    assert got["c2"].chunk_text == "chunk two" and not got["c2"].expanded_to_parent


def test_confidence_of_one_and_two_hits(spark):
    hits = spark.createDataFrame([("a", 1, 0.4567), ("b", 1, 0.8), ("b", 2, 0.4)], "query_id string, rank int, confidence double")
    got = {r.query_id: r.search_confidence for r in fu.search_confidence(hits).collect()}
    assert got == {"a": 0.4567, "b": 0.65}


def test_spread_rank_equals_row_number_for_a_hot_query(spark):
    rows = [("hot", "a", i, float(i * 37 % 101)) for i in range(900)] + [("q", "a", i, 1.0) for i in range(5)] + [("q", "b", 1, 0.5)]
    df = spark.createDataFrame(rows, "query_id string, source string, chunk_id int, score double").repartition(4)
    got = {(r.query_id, r.source, r.chunk_id): r["rank"] for r in fu.spread_rank(df, ["query_id", "source"]).collect()}
    want = {}
    for key in {(q, s) for q, s, _, _ in rows}:
        group = sorted(((-sc, c) for q, s, c, sc in rows if (q, s) == key))
        want.update({(*key, c): i + 1 for i, (_, c) in enumerate(group)})
    assert got == want


def broadcast_joins(df) -> str:
    return "\n".join(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line)


def test_texts_are_never_broadcast(spark):
    """A text's size is unknown to the planner: a small file, or a short expression, may stand for gigabytes."""
    hits = spark.createDataFrame([("q", 1, 1, "chunk one", 0.2)], "query_id string, chunk_id long, doc_id long, chunk_text string, confidence double")
    hits.scratch_path = "unused"
    parents = spark.range(5).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', 1000)").alias("text"), *[F.lit("x").alias(c) for c in ("title", "chapter", "canonical_citation")])
    whole = rt.expand_to_parents(hits, parents)
    digest = rt.expand_to_parents(hits, parents, view=F.md5)
    chunks = spark.range(5).select(F.col("id").alias("chunk_id"), F.expr("repeat('ab ', 1000)").alias("chunk_text"))
    for df in (whole, digest, rt.populate_text(hits.drop("chunk_text"), chunks)):
        assert not re.search("doc_id|chunk_id", broadcast_joins(df))
    assert digest.first().chunk_text == whole.select(F.md5("chunk_text")).first()[0] and digest.first().parent_doc_length == 3000


@pytest.mark.parametrize("name", ["w4_context_budget", "a32_context_summary", "a31_context_format", "j1_parent_expansion"])
def test_parents_are_not_broadcast(spark, name):
    assert not re.search("doc_id|partkey", broadcast_joins(entry.queries()[name](spark, FOLDER)))


def test_context_budget_needs_no_text(spark):
    rows = [("q", 1, "a" * 12_000), ("q", 2, None), ("q", 3, "b" * 3_000), ("q", 4, "c" * 31_000), ("q", 5, "d")]
    hits = spark.createDataFrame(rows, "query_id string, rank int, content string")
    whole = {r["rank"]: (r.est_tokens, r.used_before, r.content) for r in rt.within_context_budget(hits).collect()}
    assert whole == {1: (3000, 0, "a" * 2000), 3: (750, 500, "b" * 2000)}
    sizes = hits.select("query_id", "rank", F.floor(F.length("content") / 4).cast("int").alias("est_tokens"))
    assert {r["rank"]: (r.est_tokens, r.used_before) for r in rt.within_token_budget(sizes).collect()} == {k: v[:2] for k, v in whole.items()}


def test_grade_of_a_mean_at_its_floor(spark):
    """62 * 0.3 + 95 * 0.3 + 89 * 0.2 + 0.5 * 0.2 is 65; the sum of the doubles lies a last bit below it."""
    from docketlake.operators.quality import quality_score

    cols = quality_score(F.lit(0.62), F.lit(False), F.lit("excellent"), F.lit(0.89), F.lit(1), F.lit(10_000))
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    assert (row.attribution, row.coherence, row.relevance, row.citation_density) == (62.0, 95.0, 89.0, 0.5)
    assert (row.overall, row.grade) == (65.0, "C")
