from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import answers, measures, retrieval
from claimloom.streaming.progress import Progress


def tiny():
    def encode(texts):
        bare = [t.partition(": ")[2] for t in texts]
        return np.array([[t.count("a"), t.count("b") + 0.001, 1e-6] for t in bare], float)

    return encode


def test_embedding_and_search(spark):
    texts = spark.createDataFrame([(1, "aaaa", 1), (2, "bbbb", 1), (3, "abab", 1)], "claim_id int, text string, at int")
    none = spark.createDataFrame([], "claim_id int, embedding array<float>")
    stored = retrieval.store(none, texts, tiny, dim=3).cache()
    assert [(r["claim_id"]) for r in retrieval.search(stored, "b", tiny, k=2).collect()] == [2, 3]
    again = {r["claim_id"]: r["embedding"] for r in retrieval.store(stored, spark.createDataFrame([(1, "bb", 2)], "claim_id int, text string, at int"), tiny, dim=3).collect()}
    assert len(again) == 3 and again[1][1] > 0.9
    with pytest.raises(ValueError, match="blank"):
        retrieval.store(none, texts.withColumn("text", F.lit(" ")), tiny)
    assert [r["claim_id"] for r in retrieval.backfill(texts.drop("at"), stored.where("claim_id != 2"), tiny, dim=3).collect()] == [2]
    assert retrieval.backfill(texts.drop("at"), stored, tiny, force=True, limit=2, dim=3).count() == 2
    with pytest.raises(Exception, match="not 5"):
        texts.select(retrieval.embed(F.col("text"), tiny, dim=5)).collect()


def test_snippets(spark):
    hits = spark.createDataFrame([(1, "aa aa. bb bb! ab."), (2, ""), (3, "  "), (4, "bb. bb.")], "id int, text string")
    found = {r["id"]: r["snippet"] for r in retrieval.snippets(hits, "bbb", tiny, "id", "text", dim=3).collect()}
    assert found == {1: "bb bb!", 2: "", 3: "  ", 4: "bb."}


def test_hashing_encoder():
    encode = retrieval.hashing_encoder(64)
    a, b, c = encode(["query: hello world", "passage: hello world", "something else"])
    assert (a == b).all() and not (a == c).all() and encode([""]).shape == (1, 64)


def test_withholding(spark):
    row = spark.range(1).select(
        answers.retrieval_refusal(F.lit(True), F.lit(0), F.array(F.lit(1))), answers.retrieval_refusal(F.lit(True), F.lit(2), F.array(F.lit(3))), answers.retrieval_refusal(F.lit(True), F.lit(2), F.array(F.lit(2))),
        answers.sql_refusal(F.lit(True), F.lit("5"), F.lit(""), F.lit(0)), answers.sql_refusal(F.lit(True), F.lit("1.247 kayıt"), F.lit("1. n: 12"), F.lit(1)), answers.sql_refusal(F.lit(True), F.lit("12 kayıt"), F.lit("1. n: 12"), F.lit(1)),
        answers.route_mode(F.lit(True), F.lit(True)), answers.route_mode(F.lit(None).cast("boolean"), F.lit(False)),
    ).first()
    assert tuple(row) == ("no_sources", "no_valid_citation", None, "empty_result", "unverified_number", None, "hybrid", "retrieval")


def test_scoring(spark):
    none, some = F.array().cast("array<string>"), F.array(F.lit("dolu"))
    right = lambda answer, expected, more=none: answers.sql_answer_right(F.lit(True), F.lit(answer), F.lit(expected), more)
    row = spark.range(1).select(
        right("Ortalama 44.481 TL", "44480.7"), right("Ortalama 44.481 TL", "44482"), right("En çok İSTANBUL", "istanbul"), right("hasar: Dolu", "other", some), right("hiç", None),
        answers.retrieval_answer_right(F.lit(True), F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))), answers.refusal_right(F.lit(None).cast("boolean")), answers.refusal_right(F.lit(True)),
    ).first()
    assert tuple(row) == (True, False, True, True, False, True, True, False)


def test_sources_and_fields(spark):
    sources = spark.createDataFrame([(1, 2, None, None, "b"), (1, 1, "high", "2026-01-01", "a")], "q int, n int, urgency string, incident_date string, snippet string")
    assert answers.sources_block(sources, "q", "n").first()["sources"] == "[1] (aciliyet: high, olay tarihi: 2026-01-01)\na\n\n[2] (aciliyet: belirtilmemiş, olay tarihi: belirtilmemiş)\nb"
    df = spark.createDataFrame([(["plate"], {"city": 0.2, "plate": 0.9, "x": None}, {"a": '{"quote": "q"}', "b": "plain", "c": '{"value": "v"}', "d": "{}"})], "named array<string>, c map<string,double>, q map<string,string>")
    row = df.select(answers.low_confidence(F.col("named"), F.col("c")).alias("low"), answers.plain_quotes(F.col("q")).alias("q")).first()
    assert row["low"] == ["city", "plate"] and row["q"] == {"a": "q", "b": "plain", "c": "v"}
    known = spark.createDataFrame([("dün", -1), ("bugün", 0)], "text string, offset int")
    texts = spark.createDataFrame([("Dün ", datetime.datetime(2026, 8, 1)), ("yarın", datetime.datetime(2026, 8, 1))], "p string, at timestamp")
    found = {r["p"]: r["resolved_date"] for r in answers.relative_date(F.col("p"), F.col("at"), known, texts).collect()}
    assert found == {"Dün ": datetime.date(2026, 7, 31), "yarın": None}


def test_sanity_measure(spark):
    df = spark.createDataFrame([(True, ["name", "name"], "name"), (True, [], "tc"), (False, ["other"], None)], "leak boolean, kinds array<string>, kind string")
    row = measures.sanity_measure(df, F.col("leak"), F.size("kinds") > 0, F.col("kind"), F.col("kinds")).first()
    assert tuple(row) == (2, 1, 1, 1, 1)
    assert {r["kind"]: r["records"] for r in measures.kind_counts(df, F.col("kinds")).collect()} == {"name": 1, "other": 1}


def test_progress(spark, tmp_path):
    spark.range(0, 4, 1, 2).write.parquet(str(tmp_path / "t"))
    seen: list = []
    listener = Progress(seen.append)
    spark.streams.addListener(listener)
    try:
        spark.readStream.schema("id long").parquet(str(tmp_path / "t")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if any(r.get("rows") == 4 for r in seen):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert any(r.get("rows") == 4 for r in seen)
