"""Cache entries by age and expiry; golden sets in both file shapes; large windows."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docketlake.operators import cache as ca
from docketlake.operators import chunking as ch
from docketlake.sources import corpus as co

NOW = datetime(2024, 1, 2)


def test_expired_entries_are_not_served_and_the_newest_wins(spark):
    made = [("c", "k", "old", NOW - timedelta(hours=3), NOW + timedelta(hours=1)), ("c", "k", "new", NOW - timedelta(hours=1), NOW + timedelta(hours=1)), ("c", "k", "gone", NOW, NOW - timedelta(minutes=1))]
    cache = spark.createDataFrame(made, "user_type string, key string, response string, created_at timestamp, expires_at timestamp")
    cache = cache.withColumn("key", ca.cache_key(F.lit("What is section 50?")))
    ask = spark.createDataFrame([("q", "c", "What is section 50?"), ("r", "d", "What is section 50?")], "query_id string, user_type string, query string")
    got = {r.query_id: r.response for r in ca.exact_lookup(ask, cache, as_of=F.lit(NOW)).collect()}
    assert got == {"q": "new", "r": None}
    assert {r.response for r in ca.exact_lookup(ask, cache).collect()} == {"gone", None}


def test_two_levels_skip_expired_entries(spark):
    made = [(1, "c", "k", [1.0, 0.0], NOW, NOW - timedelta(1)), (2, "c", "k", [1.0, 0.0], NOW - timedelta(2), NOW + timedelta(1)), (3, "c", "k", [1.0, 0.0], NOW - timedelta(1), NOW + timedelta(1)), (4, "c", "m", [0.0, 1.0], NOW, NOW - timedelta(1))]
    cache = spark.createDataFrame(made, "item_id long, user_type string, key string, embedding array<float>, created_at timestamp, expires_at timestamp")
    ask = spark.createDataFrame([(10, "c", "k", [1.0, 0.0]), (11, "c", "x", [0.0, 1.0])], "query_id long, user_type string, key string, embedding array<float>")
    got = {r.query_id: (r.item_id, r.hit_type) for r in ca.two_level_lookup(ask, cache, cells=2, as_of=F.lit(NOW)).collect()}
    assert got == {10: (3, "exact"), 11: (None, "miss")}


def test_appended_entries_are_found(spark, tmp_path):
    path = str(tmp_path / "cache")
    for response, at in (("a", NOW), ("b", NOW + timedelta(minutes=5))):
        rows = spark.createDataFrame([("c", "What?", "simple", at)], "user_type string, query string, complexity string, created_at timestamp")
        ca.cache_append(rows.withColumn("response", F.create_map(F.lit("tldr"), F.lit(response))), path)
    cache = spark.read.parquet(path).withColumn("answer", F.col("response")["tldr"])
    ask = spark.createDataFrame([("q", "c", "What?")], "query_id string, user_type string, query string")
    assert ca.exact_lookup(ask, cache, "answer", F.lit(NOW + timedelta(minutes=6))).first().answer == "b"


def test_golden_sets_in_both_shapes(spark, tmp_path):
    queries = [{"id": "a", "query": "one", "tags": ["x"]}, {"id": "b", "query": "two", "expected_confidence_min": 0.9}]
    for name, value in (("wrapped", {"queries": queries}), ("plain", queries)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(value, indent=1))
        got = {r.id: (r.query, r.expected_confidence_min, r.tags) for r in co.read_golden(spark, str(path)).collect()}
        assert got == {"a": ("one", 0.7, ["x"]), "b": ("two", 0.9, [])}


def test_long_text_without_boundaries(spark):
    n = 200_000
    got = ch.chunk_text(spark.createDataFrame([(1, "x" * n)], "doc_id int, text string")).select(F.max("end_char"), F.count("*"), F.max("n_chunks")).first()
    assert got[0] == n and got[1] == got[2]
    assert ch.window_ends("a b. " * 3 + "c" * 40, 10, 8)[-1][1] == 55
