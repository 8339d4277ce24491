"""The stored vector index: exact form, recall of the coded form, folders read, hot cells."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docketlake.operators import vector_index as vi
from docketlake.session import materialize

FOLDERS = [f"/root/testdata/{d}" for d in ("sf0.001", "sf0.1") if os.path.isdir(f"/root/testdata/{d}")]


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(8)
    hot, centres = rng.normal(size=16), rng.normal(size=(12, 16))
    made = [(i, [float(x) for x in ((hot + 0.1 * rng.normal(size=16)) if i % 3 == 0 else centres[i % 12] + 0.4 * rng.normal(size=16))], f"t{i % 4}") for i in range(3000)]
    made.append((9999, [0.0] * 16, "zero"))
    queries = [(i, [float(x) for x in (hot if i == 0 else centres[i % 12] + 0.5 * rng.normal(size=16))]) for i in range(20)] + [(99, [0.0] * 16)]
    return spark.createDataFrame(made, "item_id long, embedding array<float>, doc_type string").repartition(5), spark.createDataFrame(queries, "query_id long, embedding array<double>"), made, queries


@pytest.fixture(scope="module")
def built(sides):
    return vi.build_vector_index(sides[0], cells=16, stretches=4, code_words=64)


def best(made, queries, k):
    v = np.array([m[1] for m in made], np.float32).astype(float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    ids, out = np.array([m[0] for m in made]), {}
    for q, x in queries:
        x = np.array(x)
        s = np.round(v @ (x / np.linalg.norm(x)) if x.any() else np.zeros(len(v)), 6)
        out[q] = [int(ids[p]) for p in np.lexsort((ids, -s))[:k]]
    return out


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_all_cells_scored_exactly_is_exact(built, sides):
    assert found(vi.stored_exact_search(built, sides[1], 6, block_rows=200)) == best(*sides[2:], 6)


def test_codes_and_rescoring_find_nine_of_ten_from_a_quarter_of_the_cells(built, sides):
    want = best(*sides[2:], 10)
    got = found(vi.stored_search(built, sides[1].where("query_id < 99"), 10, nprobe=4))
    assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.9 * 10 * len(got) == 180


def test_rescoring_everything_is_exact_and_tiles_do_not_matter(built, sides, monkeypatch):
    monkeypatch.setattr(vi, "QUERY_ROWS", 3)
    few = vi.candidates(built, sides[1], 40, 16, tile_rows=50)
    many = vi.candidates(built, sides[1], 40, 16)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert found(vi.stored_search(built, sides[1], 6, rescored=4000)) == best(*sides[2:], 6)


def test_only_probed_folders_and_codes_are_read(built, sides):
    plan = vi.candidates(built, sides[1].where("query_id = 0"), 10, 2)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "code#" in line)
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ IN \(\d+,\d+\)", scan) and "embedding" not in scan
    assert "doc_type" in built.vectors.columns and built.vectors.count() == 3001


@pytest.mark.parametrize("folder", FOLDERS)
def test_registered_search_finds_nine_of_ten(spark, folder):
    """The ten nearest of each query, from a share of the vectors that are scored exactly of at most a quarter on the larger table."""
    every, some = (entry.queries()[n](spark, folder) for n in ("r5_vector_search", "r5_stored_vector_search"))
    want = {(r.query_id, r.item_id) for r in every.where("rank <= 10").collect()}
    got = {(r.query_id, r.item_id) for r in some.collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_a_bit_filter_keeps_every_asked_row_below_the_shuffle(spark):
    from docketlake.operators.reduction import only_asked

    table = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), F.repeat(F.lit("text "), 40).alias("text"))
    keys = spark.createDataFrame([(f"k{i * 7}",) for i in range(300)] + [("absent",), (None,)], "key string")
    thin = only_asked(table, keys, "key")
    left = {r.key for r in thin.select("key").collect()}
    assert {f"k{i * 7}" for i in range(300)} <= left and len(left) < 400
    assert {r.key for r in only_asked(table, keys, "key", bits=1 << 10).select("key").collect()} >= {f"k{i * 7}" for i in range(300)}
    assert only_asked(table, keys.where("key = 'x'"), "key").count() == 0
    stored = only_asked(materialize(table, "texts"), materialize(keys, "keys"), "key")
    plan = stored.select(F.upper("key").alias("key"), "text").repartition("key")._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
    shuffled, filtered, scanned = (plan.index(what) for what in ("Exchange hashpartitioning(key", "bit_get", "FileScan"))
    assert shuffled < filtered < scanned
