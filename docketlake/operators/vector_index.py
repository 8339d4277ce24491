"""A stored index for nearest vectors: cells as partition folders, product-quantized codes, exact rescoring.

A vector is stored with the cell of its nearest centre and a code of a few bytes: for each stretch of its dimensions the number
of the nearest code word for what the centre leaves over. A search reads the codes of the probed folders alone, scores them by
table look-up, and then scores the vectors of the best candidates exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docketlake.operators.fusion import top_k
from docketlake.operators.reduction import only_asked
from docketlake.operators.vectors import _best, _hit_schema, _unit, probe_cells, tiled_search
from docketlake.session import materialize, scratch

#: Rows that the centres and code words are learned from, at most; every row is indexed.
SAMPLE = 50_000
CELLS, STRETCHES, CODE_WORDS, ROUNDS = 64, 16, 256, 8
#: Codes and queries of a tile, and candidates scored exactly for each hit that is wanted.
TILE_ROWS, QUERY_ROWS, RESCORED = 1 << 16, 1 << 10, 10


@dataclass(frozen=True)
class VectorIndex:
    """``vectors``(item_id, code, embedding, own columns, cell), the number of rows of each cell, centres and code words."""

    vectors: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    words: np.ndarray  # stretch x word x dimension within the stretch

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        learned = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/learned").collect()}  # two rows
        return VectorIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/sizes"), learned["centres"], learned["words"])


def learn_groups(vectors: np.ndarray, groups: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k-means: centres of ``groups`` groups of the rows, at most one for each row.

    First centres are drawn with odds by the squared distance to those drawn before, so a dense crowd does not take them all.
    """
    rng = np.random.default_rng(seed)
    first = [int(rng.integers(len(vectors)))]
    far = ((vectors - vectors[first[0]]) ** 2).sum(1)
    while len(first) < groups and far.sum() > 1e-12:
        first.append(min(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), side="right")), len(vectors) - 1))
        far = np.minimum(far, ((vectors - vectors[first[-1]]) ** 2).sum(1))
    centres = vectors[first].astype(np.float64)
    for _ in range(rounds):
        near = nearest(vectors, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, rows: int = 8192) -> np.ndarray:
    """Number of the nearest centre of each row, in blocks."""
    norms = (centres**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((norms - 2 * vectors[k : k + rows] @ centres.T).argmin(1) for k in range(0, len(vectors), rows))])


def encode(vectors: np.ndarray, centres: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and code of each unit vector."""
    cell = nearest(vectors, centres)
    left_over = (vectors - centres[cell]).reshape(len(vectors), len(words), -1)
    return cell, np.stack([nearest(left_over[:, s], words[s]) for s in range(len(words))], axis=1).astype(np.uint8)


def build_vector_index(
    index: DataFrame, path: str | None = None, cells: int = CELLS, stretches: int = STRETCHES, code_words: int = CODE_WORDS, sample: int = SAMPLE,
) -> VectorIndex:
    """Write index(item_id, embedding, own columns) with cells and codes to ``path``, by default to the shared scratch folder.

    Centres and code words are learned from at most about ``sample`` rows, chosen by a hash of their id; every row is indexed.
    ``stretches`` must divide the number of dimensions; a vector of zeros has a cell and a code like any other.
    """
    spark = index.sparkSession
    path = path or scratch(spark, "vector-index")
    share = min(1.0, sample / max(index.count(), 1))
    drawn = index.where(F.pmod(F.xxhash64("item_id"), F.lit(1 << 30)) < share * (1 << 30)).select("embedding").toPandas()
    if not len(drawn):
        raise ValueError("an index needs vectors")
    rows = _unit(drawn["embedding"])
    rows = rows[np.lexsort(rows.T[::-1])]  # the same order whatever the partitions
    centres = learn_groups(rows, cells)
    left_over = (rows - centres[nearest(rows, centres)]).reshape(len(rows), stretches, -1)
    words = np.stack([learn_groups(left_over[:, s], code_words) for s in range(stretches)])
    learned = spark.sparkContext.broadcast((centres, words))  # cells x dimensions and code words x dimensions numbers

    @F.pandas_udf("struct<cell:int,code:binary>")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        cell, code = encode(_unit(vectors), *learned.value)
        return pd.DataFrame({"cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

    stored = index.withColumn("_p", placed("embedding")).select(*index.columns, "_p.code", "_p.cell")
    stored.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
    facts = [(name, [float(x) for x in a.ravel()], list(a.shape)) for name, a in (("centres", centres), ("words", words))]
    spark.createDataFrame(facts, "name string, values array<double>, shape array<int>").write.mode("overwrite").parquet(f"{path}/learned")
    return VectorIndex.load(spark, path)


def _look_up(words: np.ndarray, centres: np.ndarray, k: int):
    """Best ``k`` codes of a tile for each query by sums of table entries."""

    def meet(i: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if i.empty or q.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "item_id": i["item_id"][:0], "score": []})
        asked = _unit(q["embedding"])
        codes = np.frombuffer(b"".join(i["code"]), np.uint8).reshape(len(i), len(words))
        tables = np.einsum("qsd,swd->qsw", asked.reshape(len(asked), len(words), -1), words)
        ids, qids, out = i["item_id"].to_numpy(), q["query_id"].to_numpy(), []
        base = asked @ centres[int(i["cell"].iloc[0])]
        for n in range(len(asked)):
            scores = base[n] + tables[n][np.arange(len(words)), codes].sum(1)
            best = _best(np.round(scores, 6)[None], ids, k)[0]
            out.append(pd.DataFrame({"query_id": qids[n], "item_id": ids[best], "score": scores[best]}))
        return pd.concat(out, ignore_index=True)

    return meet


def candidates(index: VectorIndex, queries: DataFrame, k: int, nprobe: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, item_id, score): the best ``k`` codes of each query(query_id, embedding) in its ``nprobe`` nearest cells."""
    probes = materialize(probe_cells(queries.select("query_id", "embedding"), index.centres, nprobe), "probes")
    met = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most as many numbers as there are cells
    codes = index.vectors.where(F.col("cell").isin(met)).select("item_id", "code", "cell")
    asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
    plan = index.sizes.select("cell", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles")).join(asked, "cell")  # a row per cell

    def part(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = codes.join(plan, "cell").select("item_id", "code", "cell", part("item_id", "tiles").alias("tile"), each("groups").alias("group"))
    right = probes.join(plan, "cell").select("query_id", "embedding", "cell", each("tiles").alias("tile"), part("query_id", "groups").alias("group"))
    keys = ["cell", "tile", "group"]
    schema = _hit_schema(index.vectors, queries)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_look_up(index.words, index.centres, k), schema)
    return top_k(found, k, ["query_id"], [F.desc("score"), F.asc("item_id")]).drop("rank")


def _cosines(pairs: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of pairs(query_id, item_id, embedding, asked) in Arrow batches."""
    schema = T.StructType([*(pairs.schema[c] for c in ("query_id", "item_id")), T.StructField("score", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                score = np.round((_unit(f["embedding"]) * _unit(f["asked"])).sum(1), 6)
                yield f[["query_id", "item_id"]].assign(score=score)

    return pairs.mapInPandas(run, schema)


def stored_search(index: VectorIndex, queries: DataFrame, k: int = 20, nprobe: int | None = None, rescored: int | None = None) -> DataFrame:
    """Best ``k`` by cosine in the ``nprobe`` nearest cells (all by default): query_id, item_id, score, rank.

    The ``rescored`` best codes of each query (RESCORED * k by default) are scored exactly; their vectors are fetched by id, and
    the table is thinned out by those ids before a vector is shuffled.
    """
    wanted = materialize(candidates(index, queries, rescored or RESCORED * k, nprobe or len(index.centres)).select("query_id", "item_id"), "candidates")
    vectors = only_asked(index.vectors.select("item_id", "embedding"), wanted.select("item_id"), "item_id")
    pairs = wanted.join(vectors, "item_id").join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
    return top_k(_cosines(pairs), k, ["query_id"], [F.desc("score"), F.asc("item_id")])


def stored_exact_search(index: VectorIndex, queries: DataFrame, k: int = 20, nprobe: int | None = None, block_rows: int = 4096) -> DataFrame:
    """As ``stored_search`` with every vector of the probed cells scored exactly; with all cells the result is exact."""
    probes = probe_cells(queries.select("query_id", "embedding"), index.centres, nprobe or len(index.centres))
    return tiled_search(index.vectors.select("item_id", "embedding", "cell"), probes, k, block_rows)
