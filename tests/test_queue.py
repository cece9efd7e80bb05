from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from claimloom.operators import retrieval
from claimloom.streaming import gauges, metrics, waits
from claimloom.streaming.queue import Queue


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def run(stream, tmp_path, fail_on=None):
    def batch(rows, n):
        if n == fail_on:
            raise RuntimeError("the worker dies")
        rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()


def test_depth_falls_and_a_restart_loses_nothing(spark, tmp_path):
    queue = Queue(spark, f"{tmp_path}/queue")
    assert queue.depth() == 0 and queue.latest() == 0
    assert queue.put(ids(spark, "1", "2", "x", None, "3")) == 5 and queue.depth() == 5
    run(queue.stream(), tmp_path)
    assert queue.settle(f"{tmp_path}/progress") == 0
    assert queue.put(ids(spark, "4", "5")) == 7 and queue.put(ids(spark)) == 7 and queue.put(ids(spark, "6")) == 8 and queue.depth() == 3
    with pytest.raises(Exception, match="dies"):
        run(queue.stream(), tmp_path, fail_on=1)
    assert queue.settle(f"{tmp_path}/progress") == 3
    run(queue.stream(), tmp_path)
    assert queue.settle(f"{tmp_path}/progress") == 0 and queue.depth("another") == 8
    found = spark.read.parquet(f"{tmp_path}/out/*")
    assert sorted(r["id"] for r in found.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["offset"] for r in found.where("id >= 4").collect()) == [5, 6, 7]


def test_counters_histogram_and_gauges(spark, tmp_path):
    totals = metrics.Totals((1.0, 5.0), keep=1)
    for k in range(3):
        spark.createDataFrame([(float(v), "a" if v % 2 else "b") for v in range(k, k + 4)] + [(None, "a")], "v double, kind string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = metrics.observed(spark.readStream.schema("v double, kind string").parquet(f"{tmp_path}/in"), {"a": F.col("kind") == "a"}, F.col("v"), (1.0, 5.0))
        q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        totals.take(q.recentProgress)
        totals.take(q.recentProgress)  # reported twice
    values = [v for k in range(3) for v in range(k, k + 4)]
    assert totals.histogram() == [(1.0, sum(v <= 1 for v in values)), (5.0, sum(v <= 5 for v in values)), (math.inf, len(values))]
    found = totals.totals()
    assert (found["counter_a"], found["sum"], found["count"], found["rows"]) == (sum(v % 2 for v in values) + 3, sum(values), len(values), len(values) + 3)
    totals.gauge("queue_depth", 4)
    text = totals.exposition()
    assert 'claimloom_seconds_bucket{le="+Inf"} 12' in text and "claimloom_queue_depth 4" in text and f"claimloom_a_total {found['counter_a']:g}" in text


def test_listener_hears_of_batches(spark, tmp_path):
    totals = metrics.Totals()
    spark.range(10).write.parquet(f"{tmp_path}/in")
    spark.streams.addListener(totals)
    try:
        stream = metrics.observed(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), {"even": F.col("id") % 2 == 0})
        stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(totals)
    assert totals.totals() == {"counter_even": 5, "rows": 10}


def at(minutes):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)


def test_gauges_move_by_difference_and_go_stale(spark, tmp_path):
    lots = [
        [(1, "review", 0, 1), (2, "review", 1, 2), (2, "approved", 2, 3), (None, "review", 3, 4)],
        [(1, "approved", 60, 5), (3, "review", 61, 6), (2, "review", 1, 7)],  # the last one comes late
        [(3, "review", 200, 8), (1, "approved", 62, 9)],
        [(9, "review", 500, 10)],
        [(2, "rejected", 501, 11)],
    ]
    counts, seen = gauges.Gauges(spark, f"{tmp_path}/counts"), []
    with gauges.rocks(spark):
        for lot in lots:
            spark.createDataFrame([(k, s, at(m), e) for k, s, m, e in lot], "k long, status string, ts timestamp, e long").write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("k long, status string, ts timestamp, e long").parquet(f"{tmp_path}/in")
            moved = gauges.changes(stream, "k", "status", "ts", "e", stale_after="2 hours", late="1 minute")
            counts.written_by(moved, f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
            seen.append({r["status"]: r["n"] for r in counts.read().collect()})
    assert seen[0] == {"review": 1, "approved": 1}
    assert seen[1] == {"review": 1, "approved": 2}
    assert {k: v for k, v in seen[2].items() if k != "stale"} == {"review": 1, "approved": 2}
    assert seen[3] == {"review": 2, "approved": 2, "stale": 3}
    assert seen[4] == {"review": 2, "approved": 1, "rejected": 1, "stale": 2}
    before = counts.read(1).collect()
    counts.add(spark.createDataFrame([("review", 5)], "status string, change long"), 0)  # an old batch again
    assert counts.read(1).collect() == before


def test_gauges_follow_a_stream_by_batches(spark, tmp_path):
    """Late, equal and repeated events, a tie by number and a batch that is run again."""
    lots = [
        [(1, "review", 0, 9), (1, "approved", 0, 10), (2, "review", 1, 2), (None, "review", 3, 4), (7, None, 3, 4)],
        [(1, "review", 60, 11), (3, "review", 61, 6), (2, "rejected", 0, 7), (2, "rejected", 1, 2)],
        [(3, "approved", 62, 8), (3, "approved", 62, 8)],
    ]
    counts, seen = gauges.Gauges(spark, f"{tmp_path}/counts"), []
    follow = lambda stream, at: counts.following(stream, "k", "status", "ts", "e", f"{tmp_path}/{at}", 4).trigger(availableNow=True).start()
    for lot in lots:
        spark.createDataFrame([(k, s, at(m), e) for k, s, m, e in lot], "k long, status string, ts timestamp, e long").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, status string, ts timestamp, e long").parquet(f"{tmp_path}/in")
        (running := follow(stream, "progress")).awaitTermination()
        assert not any(p["stateOperators"] for p in running.recentProgress)  # no key is taken alone
        seen.append({r["status"]: r["n"] for r in counts.read().collect()})
    assert seen == [{"approved": 1, "review": 1}, {"review": 3}, {"review": 2, "approved": 1}]
    follow(stream, "again").awaitTermination()  # its batch 0 is not beyond the last one
    assert {r["status"]: r["n"] for r in counts.read().collect()} == seen[-1]


def test_waits_of_tables(spark):
    routed = spark.createDataFrame([(1, at(0), 10), (1, at(5), 11), (2, at(0), 12), (None, at(0), 13)], "k long, ts timestamp, e long")
    decided = spark.createDataFrame([(1, at(6), 20), (2, at(-1), 21), (2, at(90), 22), (None, at(1), 23)], "k long, ts timestamp, e long")
    found = waits.waits(routed, decided, "k", "ts", "e", "1 hour")
    assert sorted(((r["routed_event"], r["decided_event"], r["wait_s"]) for r in found.collect()), key=str) == [(10, 20, 360.0), (11, 20, 60.0), (12, None, None), (13, None, None)]
    assert [(r["routed_event"], r["decided_event"]) for r in waits.last_routed(found).collect()] == [(11, 20)]


def test_nearest_to_many(spark):
    draw = __import__("numpy").random.default_rng(1)
    held = draw.normal(size=(300, 5)).round(1).tolist()
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(held)] + [(900, None), (901, [0.0] * 5), (902, [1.0] * 4), (None, held[0])] + [(903, held[7])], "id long, v array<double>").repartition(5)
    questions = spark.createDataFrame([(f"q{k}", held[k]) for k in range(9)] + [("none", None), ("zero", [0.0] * 5)], "q string, v array<double>")
    found: dict = {}
    for r in retrieval.search_many(vectors, questions, "id", "v", "q", k=4, block=4).orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append((r["id"], round(r["score"], 9)))
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    everything = [*enumerate(held), (903, held[7])]
    for k in range(9):
        scores = sorted((-round(sum(a * b for a, b in zip(held[k], v, strict=True)) / norm(v) / norm(held[k]), 9), i) for i, v in everything if norm(v))
        assert [(i, -s) for s, i in scores[:4]] == found[f"q{k}"]
    assert set(found) == {f"q{k}" for k in range(9)}
    assert retrieval.search_many(vectors, questions.where("false"), "id", "v", "q").count() == 0
