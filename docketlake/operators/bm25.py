"""Stored sparse index and batch BM25 search with block-max pruning.

Postings lie in blocks: one row per term and range of ``RANGE`` chunks, with the greatest gain that any chunk of the block gives.
Chunks are numbered in the order in which they lie, so blocks are made where their chunks are, and no posting is shuffled by itself.
A search first adds up these maxima per query and range, scores the most promising ranges, and then scores only the ranges
whose sum reaches the k-th score found so far. What is skipped cannot hold a hit, so results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from docketlake.constants import BM25_B, BM25_EPSILON, BM25_K1
from docketlake.functions.text import legal_tokens
from docketlake.operators.fusion import top_k
from docketlake.session import materialize, scratch

#: Bits of a chunk number within its range, and of a range within its part; parts of a term lie in different buckets.
RANGE_BITS, PART_BITS = 8, 10
#: Postings of a bucket (a folder of the stored table), and how many buckets there are at least and at most.
BUCKET_POSTINGS, MIN_BUCKETS, MAX_BUCKETS = 4_000_000, 16, 8192
#: Chunks that are counted or made into blocks at once in a Python worker.
SLICE = 2048
#: A posting is one number: the chunk's place in its range in the low 8 bits (so RANGE_BITS is 8 at most), then 28 bits each of tf
#: and dl; Spark's longest array of tokens has fewer than 2**28.
TF_SHIFT, DL_SHIFT, COUNT_MASK = 8, 36, (1 << 28) - 1
#: Ranges that a query scores first, at least.
SEEDS = 4
#: Queries of a group and bits of a range within its tile: a group is scored in a tile by one matrix product per range.
GROUP_QUERIES, TILE_BITS = 256, 6
_BLOCKS = "term string, range long, n long, top double, posts array<long>, bucket int"
_SLACK = 1e-5  # bounds and scores are sums in different orders, and scores are rounded to six digits


@dataclass(frozen=True)
class SparseIndex:
    """Tables of one stored index.

    ``chunks``(chunk_no, chunk_id, doc_id, doc_type, dl), ``blocks``(bucket, term, range, n, top, posts: the packed numbers of
    place, tf and dl), ``terms``(term, df, idf, parts), ``corpus``(n_docs, n_tokens, avgdl, k1, b, buckets, built_at).
    """

    chunks: DataFrame
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_no, tf, dl): one row per term of a chunk."""
        return self._posted(self.blocks, F.shiftleft("range", RANGE_BITS) + _place("post"), "chunk_no")

    def named_postings(self) -> DataFrame:
        """(term, chunk_id, tf, dl): the ids of a range meet its blocks, so no posting is shuffled by itself."""
        named = self.chunks.groupBy(F.shiftright("chunk_no", RANGE_BITS).alias("range")).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id"))).alias("_ids"))
        met = self.blocks.join(named.select("range", F.col("_ids.chunk_id").alias("_ids")), "range")
        return self._posted(met, F.get("_ids", _place("post").cast("int")), "chunk_id")

    @staticmethod
    def _posted(blocks: DataFrame, chunk: Column, name: str) -> DataFrame:
        tf, dl = F.shiftright("post", TF_SHIFT).bitwiseAND(F.lit(COUNT_MASK)), F.shiftrightunsigned("post", DL_SHIFT)
        return blocks.withColumn("post", F.explode("posts")).select("term", chunk.alias(name), tf.cast("int").alias("tf"), dl.cast("int").alias("dl"))

    def corpus_stats(self) -> DataFrame:
        return self.corpus.select("n_docs", "n_tokens", "avgdl")

    def term_stats(self) -> DataFrame:
        """df and idf per term; idf below zero became a share of the mean idf."""
        return self.terms.select("term", "df", "idf")

    def doc_stats(self) -> DataFrame:
        return self.chunks.select("chunk_no", "chunk_id", "doc_id", "doc_type", "dl")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseIndex:
        return SparseIndex(
            spark.read.parquet(f"{path}/chunks"), spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"),
            spark.read.parquet(f"{path}/term_stats"), spark.read.parquet(f"{path}/corpus_stats"),
        )


def _place(post: str) -> Column:
    return F.col(post).bitwiseAND(F.lit((1 << TF_SHIFT) - 1))


def _counted(chunks: DataFrame, tokens: Column) -> DataFrame:
    """chunk_no, chunk_id, doc_id, doc_type, dl, terms, tfs: each chunk's distinct tokens and counts, without a shuffle."""
    names = ["chunk_id", "doc_id", "doc_type"]
    rows = chunks.select(F.monotonically_increasing_id().alias("chunk_no"), *names, F.coalesce(tokens, F.array().cast("array<string>")).alias("_toks"))

    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            lists = batch.column("_toks")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            pairs = pa.table({"row": np.repeat(np.arange(len(lists)), sizes), "term": coded.indices}).drop_null()
            counts = pairs.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).sort_by("row").combine_chunks()
            at = pa.array(np.searchsorted(counts["row"].to_numpy(), np.arange(len(lists) + 1)).astype(np.int32))
            terms = coded.dictionary.take(counts["term"].combine_chunks())
            tfs = counts["count_all"].combine_chunks().cast(pa.int32())
            own = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sizes), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, tfs)], [*batch.schema.names[:-1], "dl", "terms", "tfs"]
            )

    kept = [f for f in rows.schema if f.name != "_toks"]
    new = [T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType([*kept, *new]))


def _gain(tf: np.ndarray, dl: np.ndarray, k1: float, b: float, avgdl: float) -> np.ndarray:
    """What a posting adds to a score, before the term's weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _blocked(counted: DataFrame, k1: float, b: float, avgdl: float) -> DataFrame:
    """term, range, top, posts: the blocks of counted chunks (chunk_no, dl, terms, tfs), made where the chunks lie.

    A range that ends in another task gives a second row for the term; bounds then add up both maxima, and counts both counts.
    """
    bits = RANGE_BITS

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        lists = rows["terms"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        number, dls = rows["chunk_no"].to_numpy(), rows["dl"].to_numpy()
        code, ranges = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), (number >> bits)[row]
        order = np.lexsort((code, ranges))  # stable: chunks stay in order within a block
        code, ranges, row = code[order], ranges[order], row[order]
        tf, dl = rows["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[order], dls[row]
        starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (ranges[1:] != ranges[:-1])][: len(code)])
        offsets = pa.array(np.r_[starts, len(code)].astype(np.int32))
        top = np.maximum.reduceat(_gain(tf, dl, k1, b, avgdl), starts) if len(starts) else np.empty(0)
        posts = (number[row] & ((1 << bits) - 1)) | (tf.astype(np.int64) << TF_SHIFT) | (dl.astype(np.int64) << DL_SHIFT)
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[starts])), pa.array(ranges[starts]), pa.array(top), pa.ListArray.from_arrays(offsets, pa.array(posts))],
            ["term", "range", "top", "posts"],
        )

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held, done = pa.concat_tables([held, rows]) if held is not None else rows, 0
            ranges = held["chunk_no"].to_numpy() >> bits
            ends = np.flatnonzero(ranges[1:] != ranges[:-1]) + 1  # the last range may go on in the next batch
            for end in ends:
                if end - done >= SLICE or end == ends[-1]:
                    yield blocks(held.slice(done, end - done))
                    done = end
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield blocks(held)

    return counted.select("chunk_no", "dl", "terms", "tfs").mapInArrow(run, "term string, range long, top double, posts array<long>")


def build_bm25(chunks: DataFrame, tokens: str | None = None, k1: float = BM25_K1, b: float = BM25_B, path: str | None = None) -> SparseIndex:
    """Write the index of ``chunks`` (chunk_id, doc_id, doc_type, chunk_text) to ``path``, by default to the shared scratch folder.

    ``tokens`` names an array column made by another tokenizer; by default chunk_text is tokenized. Counting needs no shuffle;
    blocks are made from the counts as they lie and shuffled once, to their bucket. Chunk numbers are fixed by the first table that is written.
    """
    spark = chunks.sparkSession
    path = path or scratch(spark, "index")
    _counted(chunks, F.col(tokens) if tokens else legal_tokens("chunk_text")).write.mode("overwrite").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    total = stored.agg(F.count("*").alias("n"), F.sum("dl").cast("long").alias("tokens"), F.avg("dl").alias("avgdl"), F.sum(F.size("tfs")).alias("posts")).first()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-(total["posts"] or 0) // BUCKET_POSTINGS)))
    avgdl = total["avgdl"] or 1.0

    rows = _blocked(stored, k1, b, avgdl).withColumn("bucket", _bucket("term", F.shiftright("range", PART_BITS), buckets))
    blocks = rows.repartitionById(buckets, F.col("bucket")).withColumn("n", F.size("posts").cast("long"))
    blocks.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")

    counted = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("term").agg(
        F.sum("n").alias("df"), F.collect_set(F.shiftright("range", PART_BITS)).alias("parts")
    )
    raw = F.log(total["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counted.withColumn("raw_idf", raw).write.mode("overwrite").parquet(f"{path}/term_counts")
    terms = spark.read.parquet(f"{path}/term_counts")
    floor = terms.agg(F.avg("raw_idf") * BM25_EPSILON).scalar()
    terms.select("term", "df", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf")).alias("idf"), "parts").write.mode("overwrite").parquet(f"{path}/term_stats")
    facts = [(total["n"], total["tokens"] or 0, total["avgdl"], k1, b, buckets)]
    corpus = spark.createDataFrame(facts, "n_docs long, n_tokens long, avgdl double, k1 double, b double, buckets int")
    corpus.withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    return SparseIndex.load(spark, path)


def _bucket(term: str, part: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term, part), F.lit(buckets)).cast("int")


def query_terms(queries: DataFrame, text: str = "query", tokens: str | None = None) -> DataFrame:
    """query_id, term and how often the query repeats it."""
    toks = F.col(tokens) if tokens else legal_tokens(text)
    rows = queries.select("query_id", F.explode_outer(toks).alias("term")).where(F.col("term").isNotNull())
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _best_of_tiles(blocks: DataFrame, weights: DataFrame, k: int, gain: tuple[float, float, float]) -> DataFrame:
    """(query_id, chunk_no, score): of every tile and query at least the k best chunks, with all that tie with the last of them.

    ``blocks``(group, tile, term, range, posts) meet ``weights``(group, tile, query_id, terms, weights) by group and tile.
    """
    bits, (k1, b, avgdl), slack = RANGE_BITS, gain, _SLACK
    schema = T.StructType([weights.schema["query_id"], T.StructField("chunk_no", T.LongType()), T.StructField("score", T.DoubleType())])

    def best(posted: pa.Table, asked: pa.Table) -> pa.Table:
        ids = asked["query_id"].combine_chunks()
        lists = asked["terms"].combine_chunks()
        known = lists.flatten().unique()
        weight = np.zeros((len(ids), len(known)))
        weight[np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False)), pc.index_in(lists.flatten(), known).to_numpy(zero_copy_only=False)] = asked["weights"].combine_chunks().flatten().to_numpy()
        posted = posted.sort_by("range")
        terms = pc.index_in(posted["term"].combine_chunks(), known).to_numpy(zero_copy_only=False)
        ranges = posted["range"].to_numpy()
        sizes = posted["posts"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        posts = posted["posts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        at = posts & ((1 << TF_SHIFT) - 1)
        gains = _gain((posts >> TF_SHIFT) & COUNT_MASK, posts >> DL_SHIFT, k1, b, avgdl)
        ends = np.r_[0, np.cumsum(sizes)]
        firsts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]][: len(ranges)])
        scores = np.zeros((len(ids), len(firsts) << bits))
        for i, (first, last) in enumerate(zip(firsts, np.r_[firsts[1:], len(ranges)])):
            used, place = np.unique(terms[first:last], return_inverse=True)
            dense = np.zeros((len(used), 1 << bits))
            dense[np.repeat(place, sizes[first:last]), at[ends[first] : ends[last]]] = gains[ends[first] : ends[last]]
            scores[:, i << bits : (i + 1) << bits] = weight[:, used] @ dense
        least = np.partition(scores, -k, axis=1)[:, -k] - slack if scores.shape[1] > k else np.zeros(len(ids))
        query, chunk = np.nonzero((scores > 0) & (scores >= least[:, None]))
        number = (ranges[firsts][chunk >> bits] << bits) + (chunk & ((1 << bits) - 1))
        return pa.table({"query_id": ids.take(pa.array(query)), "chunk_no": number, "score": scores[query, chunk]})

    return blocks.groupBy("group", "tile").cogroup(weights.groupBy("group", "tile")).applyInArrow(best, schema)


def bm25_search(index: SparseIndex, queries: DataFrame, k: int = 50, text: str = "query", tokens: str | None = None, seeds: int = SEEDS) -> DataFrame:
    """Top chunks per query with score above zero; scores are rounded before ranking, ties go to chunk_id.

    Query terms meet blocks by bucket, term and part of the chunk numbers, so the blocks of a frequent term spread over tasks and
    only the folders of the query terms are read. Posting lists are read for the ranges that may hold one of the k best, and
    meet the queries, in groups of bounded size, in tiles of neighbouring ranges; only the best of each tile leave it.
    """
    facts = index.corpus.select("avgdl", "k1", "b", "buckets").first()
    terms = query_terms(queries, text, tokens).join(index.terms, "term")
    wanted = terms.select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight"), F.explode("parts").alias("part"))
    wanted = materialize(wanted.withColumn("bucket", _bucket("term", F.col("part"), facts["buckets"])), "query-terms")
    met = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most MAX_BUCKETS numbers
    blocks = index.blocks.where(F.col("bucket").isin(met)).withColumn("part", F.shiftright("range", PART_BITS))

    most = F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))  # a term of negative weight adds nothing where it is absent
    bounds = materialize(
        wanted.join(blocks.select("bucket", "term", "part", "range", "top"), ["bucket", "term", "part"])
        .groupBy("query_id", "range").agg(F.sum(most).alias("bound")), "range-bounds"
    )
    groups = -(-wanted.select("query_id").distinct().count() // GROUP_QUERIES) or 1
    group, tile = F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group"), F.shiftright("range", TILE_BITS).alias("tile")
    vectors = wanted.select("query_id", "term", "weight").distinct().groupBy(group, "query_id").agg(F.collect_list(F.struct("term", "weight")).alias("v"))
    vectors = materialize(vectors.select("group", "query_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights")), "query-vectors")
    terms_of = materialize(wanted.select(group, "bucket", "term", "part").distinct(), "group-terms")
    posts = blocks.select("bucket", "term", "part", "range", "posts").join(terms_of, ["bucket", "term", "part"])

    def scored(ranges: DataFrame) -> DataFrame:
        """(query_id, chunk_no, score) of the best chunks in the ranges (query_id, range); its small sides are tables, so Spark knows their size."""
        asked = materialize(ranges.select(group, tile, "range").distinct(), "group-ranges")
        tiles = asked.select(*[F.col(c).alias(c) for c in ("group", "tile")]).distinct()
        weights = tiles.join(vectors, "group").select(*[F.col(c).alias(c) for c in ("group", "tile", "query_id", "terms", "weights")])
        met = posts.join(asked, ["group", "range"]).select("group", "tile", "term", "range", "posts")
        rows = _best_of_tiles(met, weights, k, (facts["k1"], facts["b"], facts["avgdl"] or 1.0))
        return rows.withColumn("score", F.round("score", 6)).where(F.col("score") > 0)

    first = top_k(bounds, max(seeds, -(-seeds * k >> RANGE_BITS)), ["query_id"], [F.desc("bound"), F.asc("range")])
    least = top_k(scored(first), k, ["query_id"], [F.desc("score")]).where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    reach = F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - _SLACK)
    able = materialize(bounds.join(least, "query_id", "left").where(reach).select("query_id", "range"), "ranges")
    # ties at the edge stay in until chunk_id can break them
    edge = F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))
    leading = scored(able).withColumn("_edge", edge).where(F.col("_edge") <= k).drop("_edge")
    named = leading.join(index.doc_stats().drop("dl"), "chunk_no").drop("chunk_no")
    ranked = top_k(named, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
    return ranked.withColumn("source", F.lit("bm25")).withColumn("confidence", F.least("score", F.lit(1.0)))
