"""Sources and sinks: every query writes rows of the given tables to a new folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.operators.analytics import log_row
from docketlake.operators.bm25 import SparseIndex, build_bm25
from docketlake.operators.evaluation import golden_summary
from docketlake.operators.metadata import conform_vectors
from docketlake.plans.common import CHUNK_CTE, chunks, doc_type_of_lang
from docketlake.plans.evaluation import GOLD_CTE, LEG_CTE, golden, leg_catalog, scored
from docketlake.plans.registry import query
from docketlake.plans.search import INDEX_CTE
from docketlake.schemas import CHUNK
from docketlake.session import scratch
from docketlake.sources import corpus as co


def stored_chunks(t):
    path = scratch(t.spark, "chunks")
    rows = chunks(t).select(F.col("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "doc_type", "chunk_text", "num_tokens")
    co.write_by_type(rows, path, "json")
    return path


@query("s1_read_chunks", f"WITH {CHUNK_CTE} SELECT chunk_id, doc_id::VARCHAR AS doc_id, doc_type, num_tokens, md5(chunk_text) AS text_md5 FROM chunks WHERE doc_type IN ('act', 'si')")
def s1(t):
    good, _ = co.read_chunks(t.spark, stored_chunks(t), ["act", "si"])
    return good.select("chunk_id", "doc_id", "doc_type", "num_tokens", F.md5("chunk_text").alias("text_md5"))


@query("s2_read_manifest", "SELECT doc_id, lang, source, n_chars FROM documents")
def s2(t):
    path = scratch(t.spark, "manifest")
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    docs.write.json(path)
    return co.read_manifest(t.spark, path, docs.schema)


@query("s3_list_objects")
def s3(t):
    listed = co.list_objects(t.spark, t.folder, ".parquet")
    return listed.select(F.regexp_extract("key", r"([^/]*)\z", 1).alias("name"), (F.col("size") > 0).alias("filled"))


@query("s4_read_pages", "SELECT url, md5(html) AS html_md5, length(html) AS chars FROM pages")
def s4(t):
    pages = co.read_pages(t.spark, f"{t.folder}/pages.parquet", "parquet")
    return pages.select("url", F.md5("html").alias("html_md5"), F.length("html").alias("chars"))


@query("s5_read_golden", """SELECT item_id::VARCHAR AS id, 0.7::DOUBLE AS expected_confidence_min, 'moderate' AS complexity, 0 AS tags FROM benchmark
    UNION ALL SELECT 'plain-' || item_id, 0.9::DOUBLE, 'moderate', 0 FROM benchmark""")
def s5(t):
    path = scratch(t.spark, "golden")
    t.benchmark.select(F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"))).alias("queries")).write.json(path)
    t.benchmark.select(F.concat(F.lit("plain-"), F.col("item_id")).alias("id"), F.col("text").alias("query"), F.lit(0.9).alias("expected_confidence_min")).write.mode("append").json(path)
    g = co.read_golden(t.spark, path, lines=True)
    return g.select("id", "expected_confidence_min", "complexity", F.size("tags").alias("tags"))


@query("s6_chunk_sink", f"WITH {CHUNK_CTE} SELECT doc_type, count(*) AS n, sum(num_tokens)::BIGINT AS tokens FROM chunks GROUP BY 1")
def s6(t):
    path = scratch(t.spark, "chunk-sink")
    co.write_by_type(chunks(t).select("chunk_id", "doc_type", "num_tokens"), path)
    return t.spark.read.parquet(path).groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("num_tokens").alias("tokens"))


@query("s7_parent_sink", "SELECT CASE lang WHEN 'en' THEN 'act' WHEN 'de' THEN 'si' WHEN 'fr' THEN 'ordinance' ELSE 'constitution' END AS doc_type, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def s7(t):
    path = scratch(t.spark, "parents")
    co.write_by_type(t.documents.select("doc_id", "text", "n_chars", doc_type_of_lang().alias("doc_type")), path)
    return t.spark.read.parquet(path).groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s8_manifest_append", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS batch FROM documents")
def s8(t):
    path = scratch(t.spark, "manifest")
    docs = t.documents.select("doc_id")
    co.append_new(docs.join(t.labels.select("doc_id"), "doc_id", "left_semi").withColumn("batch", F.lit("first")), path, "doc_id", "json")
    co.append_new(docs.withColumn("batch", F.lit("second")), path, "doc_id", "json")
    return co.read_keyed(t.spark, path, "json", "doc_id long, batch string")


@query("s9_catalog_sink", f"WITH {LEG_CTE} SELECT nature AS court, count(*) AS n FROM cat GROUP BY 1")
def s9(t):
    rows = leg_catalog(t).select("year", F.col("nature").alias("court"), F.col("nature").alias("court_code"), F.col("akn_uri").alias("case_number"))
    path = scratch(t.spark, "catalog")
    co.write_catalog(rows, path)
    return t.spark.read.json(path).groupBy("court").agg(F.count("*").alias("n"))


@query("s10_vector_sink", "SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS doc_type, len(embedding) AS dim FROM embeddings")
def s10(t):
    path = scratch(t.spark, "vectors")
    rows = t.embeddings.select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("doc_type"), F.concat(F.lit("k/"), "vec_id").alias("chunk_object_key"))
    table, _ = conform_vectors(rows)
    co.append_new(table, path, "chunk_id", partition=["doc_type"])
    co.append_new(table, path, "chunk_id", partition=["doc_type"])
    back = t.spark.read.schema("chunk_id string, embedding array<float>, doc_type string").parquet(path)
    return back.select("chunk_id", "doc_type", F.size("embedding").alias("dim"))


def saved_index(t):
    path = scratch(t.spark, "index")
    build_bm25(chunks(t), path=path)
    return path


@query("s11_index_sink", f"WITH {INDEX_CTE} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def s11(t):
    return SparseIndex.load(t.spark, saved_index(t)).term_stats().select("term", "df", F.round("idf", 6).alias("idf"))


@query("s12_report_sink", f"WITH {GOLD_CTE} SELECT count(*) AS total_queries, round(avg(correctness), 6) AS avg_correctness FROM scored")
def s12(t):
    path = scratch(t.spark, "report")
    golden_summary(scored(t)).write.json(path)
    return t.spark.read.json(path).select("total_queries", F.round("avg_correctness", 6).alias("avg_correctness"))


@query("s13_log_sink", "SELECT conv_id, turn, length(left(text, 1000)) AS chars FROM conversations")
def s13(t):
    path = scratch(t.spark, "log")
    log_row(t.conversations.select("conv_id", "turn", F.col("text").alias("query_text"))).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).select("conv_id", "turn", F.length("query_text").alias("chars"))


KEY_SQL = "CASE lang WHEN 'en' THEN 'sources/' || source || '.pdf' WHEN 'de' THEN 'sources/' || source || '.txt' WHEN 'fr' THEN 'corpus/docs/../' || source ELSE 'corpus/docs/' || source END"


@query("s14_valid_keys", f"SELECT doc_id, {KEY_SQL} AS key, lang IN ('en', 'es') AND n_chars * 10000 <= 50000000 AS valid FROM documents")
def s14(t):
    lang, src = F.col("lang"), F.col("source")
    key = (
        F.when(lang == "en", F.concat(F.lit("sources/"), src, F.lit(".pdf"))).when(lang == "de", F.concat(F.lit("sources/"), src, F.lit(".txt")))
        .when(lang == "fr", F.concat(F.lit("corpus/docs/../"), src)).otherwise(F.concat(F.lit("corpus/docs/"), src))
    )
    return t.documents.select("doc_id", key.alias("key"), co.valid_key(key, F.col("n_chars") * 10000).alias("valid"))


@query("s15_index_freshness", f"WITH {INDEX_CTE} SELECT n_docs AS corpus_size, true AS is_fresh FROM corpus")
def s15(t):
    stats = t.spark.read.parquet(f"{saved_index(t)}/corpus_stats")
    return co.index_freshness(stats, F.current_timestamp()).select("corpus_size", "is_fresh")
