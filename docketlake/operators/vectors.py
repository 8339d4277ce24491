"""Embedding, exact and approximate nearest-vector search.

Search is a tiled join: index and query rows are cut into blocks of bounded size, blocks meet on an
equi-key, and each meeting is one small matrix product that returns only its best k per query. No
frame of query x vector pairs is ever shuffled, and a cell holding a third of all rows is just more tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docketlake.operators.fusion import top_k
from docketlake.session import materialize

BLOCK_ROWS = 4096
MOST_CELLS = 1024
BROADCAST_BYTES = 32 * 1024 * 1024
#: Bytes of vectors that a worker holds before it sends them on.
EMBED_BYTES = 4 << 20


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two array columns, 0 where a norm is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)

    def d(x):
        return x.cast("double")

    dot = total(F.zip_with(a, b, lambda x, y: d(x) * d(y)))
    norms = F.sqrt(total(F.transform(a, lambda x: d(x) * d(x)))) * F.sqrt(total(F.transform(b, lambda x: d(x) * d(x))))
    return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))


def embed(
    df: DataFrame, fn: Callable[[list[str]], np.ndarray], dim: int, text: str = "chunk_text",
    batch: int = 50, on_error: str = "error",
) -> DataFrame:
    """Add ``embedding`` (and ``embedded``); with on_error="zeros" a failed batch gets zero vectors.

    Vectors leave the worker in pieces of bounded size, whatever the number of rows that Spark sends at once.
    """
    schema = T.StructType(
        df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedded", T.BooleanType())]
    )
    step = batch * max(1, EMBED_BYTES // (4 * batch * max(1, dim)))

    def vectors_of(texts: list[str]) -> tuple[np.ndarray, list[bool]]:
        vectors, flags = [], []
        for i in range(0, len(texts), batch):
            asked = texts[i : i + batch]
            try:
                vectors.append(np.asarray(fn(asked), dtype=np.float32))
                flags += [True] * len(asked)
            except Exception:
                if on_error != "zeros":
                    raise
                vectors.append(np.zeros((len(asked), dim), dtype=np.float32))
                flags += [False] * len(asked)
        return np.concatenate(vectors), flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            vectors, flags = vectors_of(rows.column(text).to_pylist())
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            embedding = pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*rows.columns, embedding, pa.array(flags)], [*rows.schema.names, "embedding", "embedded"])

    return df.mapInArrow(run, schema)


def _unit(rows) -> np.ndarray:
    m = np.asarray(list(rows), dtype=np.float64)
    if m.ndim != 2:
        m = m.reshape(len(m), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the positions of the k best, ties by id; scores are rounded so that ties are ties."""
    out = []
    for row in scores:
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            pos = np.flatnonzero(row >= edge)
        else:
            pos = np.arange(len(row))
        out.append(pos[np.lexsort((ids[pos], -row[pos]))[:k]])
    return out


def _score(index_ids, index_vectors, query_ids, query_vectors, k) -> pd.DataFrame:
    ids, qids = np.asarray(index_ids), np.asarray(query_ids)
    scores = np.round(_unit(query_vectors) @ _unit(index_vectors).T, 6)
    picks = _best(scores, ids, k)
    return pd.DataFrame(
        {
            "query_id": np.repeat(qids, [len(p) for p in picks]),
            "item_id": ids[np.concatenate(picks)] if picks else ids[:0],
            "score": np.concatenate([scores[i, p] for i, p in enumerate(picks)]) if picks else [],
        }
    )


def _hit_schema(index: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("item_id", index.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _score_above(threshold: float):
    """Scoring of a tile for hits that reach a threshold: pairs that cannot reach it are dropped by a part of their products."""

    def score(index_ids, index_vectors, query_ids, query_vectors, k) -> pd.DataFrame:
        ids, qids = np.asarray(index_ids), np.asarray(query_ids)
        at, item, scores = pairs_above(_unit(query_vectors), _unit(index_vectors), threshold)
        order = np.lexsort((ids[item], -scores, at))
        at, item, scores = at[order], item[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        return pd.DataFrame({"query_id": qids[at], "item_id": ids[item], "score": scores})[place < k]

    return score


def pairs_above(queries: np.ndarray, items: np.ndarray, threshold: float, share: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, cosine) of unit vectors whose rounded cosine reaches the threshold.

    The leading dimensions give a part of each product; what the rest can add is at most the product of the two remaining norms.
    Only pairs that may still reach the threshold are multiplied out.
    """
    lead = max(1, int(queries.shape[1] * share))
    able = queries[:, :lead] @ items[:, :lead].T
    able += np.outer(np.linalg.norm(queries[:, lead:], axis=1), np.linalg.norm(items[:, lead:], axis=1))
    at, item = np.nonzero(able >= threshold - 1e-6)
    scores = np.empty(len(at))
    step = max(1, (1 << 22) // queries.shape[1])
    for b in range(0, len(at), step):
        scores[b : b + step] = np.einsum("nd,nd->n", queries[at[b : b + step]], items[item[b : b + step]])
    scores = np.round(scores, 6)
    keep = scores >= threshold
    return at[keep], item[keep], scores[keep]


def tiled_search(index: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, score=_score) -> DataFrame:
    """index(item_id, embedding, cell) against queries(query_id, embedding, cell), best k per query.

    A query may appear in several cells. Blocks per cell follow the cell's row count, so no tile
    grows with the data.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
        return sizes

    plan = blocks(index, "n_i").join(blocks(queries, "n_q"), "cell")

    def tiles(df: DataFrame, key: str, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        return (
            df.join(plan, "cell")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .select(key, "embedding", "cell", "_ib", "_qb")
        )

    left = tiles(index, "item_id", "_ib", "_qb", "n_i", "n_q")
    right = tiles(queries, "query_id", "_qb", "_ib", "n_q", "n_i")

    def meet(i: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if i.empty or q.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "item_id": i["item_id"][:0], "score": []})
        return score(i["item_id"], i["embedding"], q["query_id"], q["embedding"], k)

    key = ["cell", "_ib", "_qb"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, _hit_schema(index, queries))
    return top_k(hits, k, ["query_id"], [F.desc("score"), F.asc("item_id")])


def vector_search(
    index: DataFrame, queries: DataFrame, k: int = 20, keep: Column | None = None, by: str | None = None,
    dim: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine top k. ``keep`` filters the index before scoring, ``by`` makes both sides match on a column.

    Queries whose vectors fit a fixed byte bound are shipped to the scan, so the index is not
    shuffled at all; above the bound both sides are tiled.
    """
    if keep is not None:
        index = index.where(keep)
    cell = F.col(by) if by else F.lit(0)
    if dim is not None and by is None:
        limit = BROADCAST_BYTES // (8 * dim)
        sample = queries.select("query_id", "embedding").limit(limit + 1).toPandas()
        if len(sample) <= limit:
            return _scan_search(index, queries, sample, k)
    return tiled_search(
        index.select("item_id", "embedding", cell.alias("cell")),
        queries.select("query_id", "embedding", cell.alias("cell")), k, block_rows,
    )


def _scan_search(index: DataFrame, queries: DataFrame, small: pd.DataFrame, k: int) -> DataFrame:
    shipped = index.sparkSession.sparkContext.broadcast(
        (small["query_id"].to_numpy(), _unit(small["embedding"]) if len(small) else np.zeros((0, 1)))
    )

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qvecs = shipped.value
        best = None
        for pdf in frames:
            if pdf.empty or len(qids) == 0:
                continue
            hits = _score(pdf["item_id"], pdf["embedding"], qids, qvecs, k)
            best = hits if best is None else (
                pd.concat([best, hits]).sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
                .groupby("query_id", sort=False).head(k)
            )
        if best is not None:
            yield best

    hits = index.select("item_id", "embedding").mapInPandas(scan, _hit_schema(index, queries))
    return top_k(hits, k, ["query_id"], [F.desc("score"), F.asc("item_id")])


# --- cells -----------------------------------------------------------------


def pick_centroids(index: DataFrame, cells: int, rounds: int = 2) -> np.ndarray:
    """Cell centres: vectors chosen by hash, refined by partial sums per partition. At most ``cells`` rows reach the driver."""
    first = index.select("embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(cells).toPandas()
    centres = _unit(first["embedding"])
    schema = "cell int, sums array<double>"
    for _ in range(rounds):
        fixed = index.sparkSession.sparkContext.broadcast(centres)

        def partial(frames):
            c = fixed.value
            sums, seen = np.zeros_like(c), np.zeros(len(c), dtype=bool)
            for pdf in frames:
                if len(pdf):
                    v = _unit(pdf["embedding"])
                    nearest = (v @ c.T).argmax(axis=1)
                    np.add.at(sums, nearest, v)
                    seen[nearest] = True
            yield pd.DataFrame({"cell": np.flatnonzero(seen).astype(np.int32), "sums": pd.Series(list(sums[seen]), dtype=object)})

        merged = (
            index.select("embedding").mapInPandas(partial, schema)
            .select("cell", F.posexplode("sums").alias("d", "x"))
            .groupBy("cell", "d").agg(F.sum("x").alias("x"))
            .groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("xs"))
            .select("cell", F.transform("xs", lambda p: p["x"]).alias("sums"))
            .toPandas()
        )
        moved = centres.copy()
        moved[merged["cell"].to_numpy()] = _unit(merged["sums"])
        centres = moved
    return centres


def assign_cells(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Nearest centre as ``cell`` and the angle to it."""
    fixed = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        s = _unit(vectors) @ fixed.value.T
        c = s.argmax(axis=1)
        return pd.DataFrame({"cell": c.astype(np.int32), "angle": np.arccos(np.clip(s[np.arange(len(c)), c], -1, 1))})

    return df.withColumn("_n", nearest("embedding")).select(*df.columns, "_n.cell", "_n.angle")


def probe_cells(queries: DataFrame, centres: np.ndarray, nprobe: int) -> DataFrame:
    """One row per query and each of its ``nprobe`` nearest cells."""
    fixed = queries.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        s = _unit(vectors) @ fixed.value.T
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :nprobe].astype(np.int32)))

    return queries.withColumn("cell", F.explode(nearest("embedding")))


def approximate_search(
    index: DataFrame, queries: DataFrame, k: int = 20, cells: int = 64, nprobe: int = 8, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Search only the nearest cells of every query; nprobe = cells is exact."""
    centres = pick_centroids(index, cells)
    return tiled_search(assign_cells(index, centres).drop("angle"), probe_cells(queries, centres, nprobe), k, block_rows)


def nearest_above(
    index: DataFrame, queries: DataFrame, threshold: float, by: str, cells: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Best match of every query within its ``by`` group if its cosine reaches the threshold; exact.

    Cells (by default the root of the number of vectors, at most MOST_CELLS) are skipped by the triangle inequality on angles: a
    cell whose centre is further from the query than its radius plus the threshold angle cannot hold a match. Within a
    cell, pairs are dropped by the products of their leading dimensions before they are scored.
    """
    cells = cells or min(MOST_CELLS, max(16, int(index.count() ** 0.5)))
    centres = pick_centroids(index, cells)
    placed = materialize(assign_cells(index, centres), "cells")
    radii = placed.groupBy(by, "cell").agg(F.max("angle").alias("radius"))
    widest = np.full(len(centres), -np.inf)  # one number per cell over all groups
    for row in placed.groupBy("cell").agg(F.max("angle").alias("radius")).collect():
        widest[row["cell"]] = row["radius"]
    fixed = queries.sparkSession.sparkContext.broadcast((centres, widest))
    slack = float(np.arccos(threshold)) + 1e-6

    @F.pandas_udf("array<struct<cell:int,angle:double>>")
    def reachable(vectors: pd.Series) -> pd.Series:
        c, radius = fixed.value
        angles = np.arccos(np.clip(_unit(vectors) @ c.T, -1, 1))
        return pd.Series([
            [{"cell": int(j), "angle": float(row[j])} for j in np.flatnonzero(row <= radius + slack)] for row in angles
        ])

    reach = queries.select("query_id", "embedding", by, F.explode(reachable("embedding")).alias("_c")).select(
        "query_id", "embedding", by, "_c.cell", "_c.angle"
    )
    reach = reach.join(radii, [by, "cell"]).where(F.col("angle") <= F.col("radius") + slack)
    group = F.struct(F.col(by), F.col("cell"))
    hits = tiled_search(
        placed.select("item_id", "embedding", F.to_json(group).alias("cell")),
        reach.select("query_id", "embedding", F.to_json(group).alias("cell")), 1, block_rows, _score_above(threshold),
    )
    return hits.drop("rank")
