"""Streaming operators give what their batch forms give; sources and sinks."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.operators import analytics as an
from docketlake.schemas import CHUNK
from docketlake.sources import corpus as co
from docketlake.streaming import ingest, limits as li, state as st, summaries as su

T0 = datetime(2024, 1, 1)


def brute_limits(rows, limits, ban):
    state, out = {}, {}
    for rid, client, sec, flagged in sorted(rows, key=lambda r: (r[2], r[0])):
        times, until = state.setdefault(client, ([], 0.0))
        if sec < until:
            out[rid] = "banned"
        elif any(sum(sec - x < s for x in times) >= n for n, s in limits):
            out[rid] = "limited"
        else:
            times.append(sec)
            out[rid] = "bot" if flagged else "admitted"
            state[client] = (times, sec + ban if flagged else until)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out, sec = [], 1_704_067_200.0
    for i in range(600):
        sec += rng.choice([0.5, 3, 10, 30, 90, 200])
        out.append((i, rng.choice(["hot", "hot", "b", "c"]), sec, rng.random() < 0.03))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "request_id long, client string, sec double, flagged boolean")
    return df.select("request_id", "client", F.timestamp_seconds("sec").alias("ts"), "flagged")


@pytest.mark.parametrize("limits, ban", [([(3, 60)], 0), ([(2, 60), (5, 600)], 120)])
def test_batch_limits_equal_brute_force(spark, rows, limits, ban):
    got = {r.request_id: r.status for r in li.limit_requests(frame(spark, rows).repartition(5), limits, ban, bucket=300.0).collect()}
    assert got == brute_limits(rows, limits, ban)
    assert len(set(got.values())) >= 2


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert not q.isActive
    return df.sparkSession.table(name)


def stream_of(spark, df, path, files=4, order="ts"):
    """Write rows as several files in time order and read them back as a stream of one file per batch."""
    data = df.orderBy(order).collect()
    step = -(-len(data) // files)
    for i in range(files):
        spark.createDataFrame(data[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_limits_equal_batch(spark, rows, tmp_path):
    df = frame(spark, rows)
    source = stream_of(spark, df, tmp_path / "in").withWatermark("ts", "1 hour")
    got = {r.request_id: r.status for r in drain(li.limit_stream(source, [(2, 60), (5, 600)], 120), "limits", "append").collect()}
    assert got == brute_limits(rows, [(2, 60), (5, 600)], 120)


def test_cache_entries_expire(spark, tmp_path):
    puts = spark.createDataFrame(
        [("k1", "a", T0, 60), ("k2", "b", T0 + timedelta(minutes=1), 7200), ("k3", "c", T0 + timedelta(hours=1), 60), ("k4", "d", T0 + timedelta(hours=1, minutes=1), 60)],
        "key string, response string, ts timestamp, ttl_s int")
    out = drain(st.cache_stream(stream_of(spark, puts, tmp_path / "in").withWatermark("ts", "1 second")), "cache", "append").collect()
    assert {r.key for r in out if r.event == "put"} == {"k1", "k2", "k3", "k4"}
    expired = {r.key for r in out if r.event == "expired"}
    assert "k1" in expired and "k2" not in expired


def test_recent_messages_stream(spark, tmp_path):
    rows = [("s", i, T0 + timedelta(minutes=i), "user", f"m{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "session_id string, turn long, ts timestamp, role string, content string")
    out = drain(st.recent_messages_stream(stream_of(spark, df, tmp_path / "in").withWatermark("ts", "1 hour"), n=5), "recent", "update")
    assert {r.turn for r in out.collect() if r.turn >= 7} == {7, 8, 9, 10, 11}


def test_rolling_summary_stream_equals_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=7 * i), i % 5, float(i), "success" if i % 3 else "error", [1, 0, -1][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id int, response_time_ms double, status string, rating int")
    batch = {r.window_start: (r.total_queries, r.positive) for r in su.rolling_summary(df, "6 hours", "1 hour").collect()}
    live = drain(su.rolling_summary(stream_of(spark, df, tmp_path / "in"), "6 hours", "1 hour"), "rolling", "append").collect()
    assert live and all(batch[r.window_start] == (r.total_queries, r.positive) for r in live)


def test_first_signups_and_profiles(spark, tmp_path):
    rows = [("a@x.org", T0, 1), ("b@x.org", T0 + timedelta(minutes=1), 2), ("a@x.org", T0 + timedelta(minutes=2), 3)]
    df = spark.createDataFrame(rows, "email string, joined_at timestamp, waitlist_id int")
    live = drain(st.first_signups(stream_of(spark, df, tmp_path / "in", 1, "joined_at").withWatermark("joined_at", "1 hour")), "signups", "append")
    assert {r.email for r in live.collect()} == {"a@x.org", "b@x.org"} and live.count() == 2
    assert {r.waitlist_id for r in st.earliest(df).collect()} == {1, 2}


def test_new_files_are_ingested_once(spark, tmp_path):
    folder, sink = tmp_path / "in", str(tmp_path / "sink")
    folder.mkdir()
    schema = "doc_id string, text string"
    from pyspark.sql.types import _parse_datatype_string

    for name, ids in (("a", ["1", "2"]), ("b", ["2", "3"])):
        (folder / f"{name}.json").write_text("\n".join(json.dumps({"doc_id": i, "text": name}) for i in ids))
        ingest.ingest_files(spark, str(folder), _parse_datatype_string(schema), sink, "doc_id", str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == ["1", "2", "3"]


def test_chunk_files_and_broken_rows(spark, tmp_path):
    folder = tmp_path / "chunks" / "doc_type=act"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text(json.dumps({"chunk_id": "c1", "doc_id": "d", "chunk_text": "text", "entities": {"courts": ["x"]}}))
    (folder / "2.json").write_text("{broken")
    good, bad = co.read_chunks(spark, str(tmp_path / "chunks"), ["act"])
    assert [(r.chunk_id, r.doc_type) for r in good.collect()] == [("c1", "act")] and good.collect()[0].chunk_object_key.endswith("1.json")
    assert bad.count() == 1 and "chunk_text" in CHUNK.fieldNames()


def test_listing_keys_and_golden(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_text("x")
    assert [r["size"] for r in co.list_objects(spark, str(tmp_path)).collect()] == [5]
    keys = ["sources/a.pdf", "sources/a.txt", "corpus/docs/x", "/sources/a.pdf", "sources/../a.pdf", "other/a.pdf", ""]
    got = [r.ok for r in spark.createDataFrame([(k,) for k in keys], "k string").select(co.valid_key("k").alias("ok")).collect()]
    assert got == [True, False, True, False, False, False, False]
    (tmp_path / "golden.json").write_text(json.dumps({"queries": [{"id": "1", "query": "q", "category": "c"}]}, indent=1))
    g = co.read_golden(spark, str(tmp_path / "golden.json")).collect()[0]
    assert (g.expected_confidence_min, g.complexity, g.tags) == (0.7, "moderate", [])
    (tmp_path / "p.html").write_text("<p>a\nb</p>")
    assert co.read_pages(spark, str(tmp_path / "p.html")).collect()[0].html == "<p>a\nb</p>"


def test_order_statistics_with_a_hot_key(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice([1.0, 1.0, 2.5, rng.random() * 100])) for _ in range(3000)] + [("small", float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in an.order_statistics(df, ["k"], "v", {"p": an.at_fraction(0.95)}).collect()}
    for key in ("hot", "small"):
        values = sorted(v for k, v in rows if k == key)
        assert got[key] == values[int(0.95 * len(values))]


def test_order_statistics_of_groups_of_every_size(spark):
    rng = random.Random(11)
    rows = [(n, rng.choice([float(rng.randrange(5)), rng.random() * 100])) for n in range(1, 90) for _ in range(n)] + [(1000, rng.random()) for _ in range(20_000)] + [(2000, None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    got = {r.k: (r.p, r.a, r.b) for r in an.order_statistics(df.where("k is not null"), ["k"], "v", {"p": an.at_fraction(0.95), "a": (0.5, low), "b": (0.5, high)}).collect()}
    want = {}
    for k in {k for k, _ in rows if k not in (None, 2000)}:
        v = sorted(x for key, x in rows if key == k)
        want[k] = (v[int(0.95 * len(v))], v[(len(v) - 1) // 2], v[len(v) // 2])
    assert got == want


def test_a_hot_key_is_ordered_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
        stats = an.order_statistics(df, ["k"], "v", {"p": an.at_fraction(0.5), "q": (0.5, F.col("n") - F.col("n") / 2 + 100)})
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(_part" in plan and tuple(stats.first()) == ("hot", 30_000.0, 30_100.0)
        files = [f for f in stats.inputFiles() if "ordered-values" in f]
        assert len(files) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_welch_columns(spark):
    rows = [("e", "control", float(x)) for x in (1, 2, 3, 4)] + [("e", "b", float(x)) for x in (2, 4, 6, 9, 9)] + [("e", "one", 1.0), ("f", "control", 1.0), ("f", "b", 1.0)]
    got = {(r.experiment_id, r.variant): (r.welch_t, r.welch_df) for r in an.compare_variants(spark.createDataFrame(rows, "experiment_id string, variant string, m double"), "m", "control").collect()}
    a, b = np.array([1, 2, 3, 4.0]), np.array([2, 4, 6, 9, 9.0])
    va, vb = a.var(ddof=1) / 4, b.var(ddof=1) / 5
    assert got[("e", "b")] == (round((b.mean() - a.mean()) / (va + vb) ** 0.5, 6), round((va + vb) ** 2 / (va**2 / 3 + vb**2 / 4), 4))
    assert got[("e", "one")] == got[("f", "b")] == (None, None)


def test_keyed_append_reads_the_folders_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(f"k{i}", i, {"a": i}) for i in range(400)] + [("k1", 0, {"b": 1}), ("k2", 900, {"c": 1}), ("k2", -1, {"d": 1})]
    df = spark.createDataFrame(rows, "id string, n int, facts map<string,int>").repartition(3)
    added = co.append_new(df, path, "id", order=["n"], folders=8)
    assert added.count() == 400 and added.columns == ["id", "n", "facts"]
    kept = {r.id: r.n for r in co.read_keyed(spark, path).collect()}
    assert kept["k1"] == 0 and kept["k2"] == -1 and len(kept) == 400
    again = co.append_new(spark.createDataFrame([("k5", 1, None), ("new", 2, None), ("new", 1, None)], df.schema), path, "id", order=["n"], folders=64)
    assert [tuple(r) for r in again.collect()] == [("new", 1, None)]
    table = co.read_keyed(spark, path)
    assert table.count() == table.select("id").distinct().count() == 401
    assert {f.name for f in (tmp_path / "table").iterdir() if f.is_dir()} == {f"key_of_8={k}" for k in range(8)}
    plan = spark.read.parquet(path).where("key_of_8 in (3)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_of_8" in plan


def test_keyed_append_to_a_table_without_folders_and_of_keys_alone(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.createDataFrame([(1,), (2,)], "id long").write.json(path)
    assert co.append_new(spark.createDataFrame([(2,), (3,), (3,)], "id long"), str(tmp_path / "other"), "id", "json").count() == 2
    assert [r.id for r in co.append_new(spark.createDataFrame([(2,), (3,), (3,)], "id long"), str(tmp_path / "other"), "id", "json").collect()] == []
    assert [r.id for r in co.unprocessed(spark.createDataFrame([(2,), (3,)], "id long"), spark.read.json(path), "id").collect()] == [3]


def test_limits_go_on_after_a_restart(spark, rows, tmp_path):
    """Half of the requests, a stop, the other half from the checkpoint: the decisions of one run over all of them."""
    df = frame(spark, rows)
    data = df.orderBy("ts").collect()
    for part, name in ((data[: len(data) // 2], "a"), (data[len(data) // 2 :], "b")):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
        query = li.limit_stream(source, [(2, 60), (5, 600)], 120).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.request_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(rows) and dict(got) == brute_limits(rows, [(2, 60), (5, 600)], 120)
