from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimloom.streaming.keyed import Conflict, KeyedTable

SCHEMA = "id long, at int, text string, more map<string,int>"


def made(spark, tmp_path, **options):
    return KeyedTable(spark, f"{tmp_path}/table", SCHEMA, "id", ("at",), **{"buckets": 8} | options)


def rows(spark, data):
    return spark.createDataFrame([(i, a, t, {"x": a}) for i, a, t in data], SCHEMA)


def held(table):
    return sorted((r["id"], r["at"], r["text"]) for r in table.read().collect())


def test_last_row_of_each_key(spark, tmp_path):
    table, last = made(spark, tmp_path), {}
    draw = random.Random(4)
    for batch in range(6):
        data = [(draw.randrange(30), draw.randrange(100), f"{batch}-{k}") for k in range(20)]
        data = list({(i, a): (i, a, t) for i, a, t in data}.values())
        for i, a, t in data:
            if i not in last or a >= last[i][0]:
                last[i] = (a, t)
        table.merge(rows(spark, data), batch)
        table.merge(rows(spark, data), batch)  # run again
        assert held(table) == sorted((i, *x) for i, x in last.items())
    assert table.manifest().version == 6


def test_an_id_in_three_batches_of_a_stream_is_one_row(spark, tmp_path):
    table = made(spark, tmp_path)
    for k, text in enumerate(["first", "second", "third"]):
        rows(spark, [(1, 5, text), (k + 10, 1, text)]).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        table.written_by(stream, f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    assert held(table) == [(1, 5, "third"), (10, 1, "first"), (11, 1, "second"), (12, 1, "third")]


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    table = made(spark, tmp_path)
    table.merge(rows(spark, [(k, 1, "a") for k in range(100)]))
    before = table.manifest().folders
    table.merge(rows(spark, [(7, 2, "b")]))
    after = table.manifest().folders
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert [tuple(r)[:3] for r in table.lookup(7).collect()] == [(7, 2, "b")]
    assert table.lookup(7).inputFiles() and all(f"_bucket={next(b for b in before if before[b] != after[b])}/" in f for f in table.lookup(7).inputFiles())
    assert table.lookup(1000).count() == 0


def test_a_reader_keeps_its_manifest_and_old_files_go(spark, tmp_path):
    table = made(spark, tmp_path, keep=2)
    table.merge(rows(spark, [(1, 1, "a")]))
    old = table.read()
    table.merge(rows(spark, [(1, 2, "b")]))
    assert [r["text"] for r in old.collect()] == ["a"]
    for k in range(3, 7):
        table.merge(rows(spark, [(1, k, "c")]))
    assert len(table.store.names("manifests")) == 2 and len(table.store.names("data")) == 2 and held(table) == [(1, 6, "c")]


def test_conflicts_null_keys_and_empty_batches(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path)
    assert table.read().count() == 0 and table.lookup(1).count() == 0
    table.merge(rows(spark, []), 0)
    assert table.manifest().version == 1 and table.read().count() == 0
    with pytest.raises(ValueError):
        table.merge(rows(spark, [(None, 1, "x"), (2, 1, "y")]))
    other = made(spark, tmp_path, buckets=99)
    seen = other.manifest()
    assert seen.buckets == 8
    table.merge(rows(spark, [(3, 1, "z")]).withColumn("extra", F.lit(1)))
    monkeypatch.setattr(other, "manifest", lambda version=None: seen)
    with pytest.raises(Conflict):
        other.merge(rows(spark, [(4, 1, "w")]))
    assert held(table) == [(3, 1, "z")]


def test_several_key_columns(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/table", "a string, b int, n int", ("a", "b"), ("n",), 4)
    frame = spark.createDataFrame([("x", 1, 1), ("x", 2, 1), ("x", 1, 2)], "a string, b int, n int")
    table.merge(frame)
    assert sorted(map(tuple, table.read().collect())) == [("x", 1, 2), ("x", 2, 1)] and table.lookup("x", 2).count() == 1
