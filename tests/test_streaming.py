from __future__ import annotations

import dataclasses
import datetime
import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions.masking import STARTER_NAMES
from claimloom.functions.signals import SignalRules, signals
from claimloom.streaming import triage, windows

MESSAGES = [
    (1, "email", "Ahmet aradı. Plaka 34ABC123 dün çarptım, yaralanan oldu.", "A", "2026-08-01 10:00:00"),
    (2, "email", "Kampanya hakkında bilgi", "B", "2026-08-01 10:01:00"),
    (3, "web_form", None, "C", "2026-08-01 10:02:00"),
    (4, "web_form", "Cam kırıldı. Plaka 06XYZ99", "D", "2026-08-01 10:03:00"),
]


@pytest.fixture(scope="module")
def world(spark):
    both = lambda rows: spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "external_ref string, payload string")
    answers = triage.Answers(
        both([("B", {"content_type": "info_request", "urgency": "normal"}), ("*", {"content_type": "claim", "urgency": "normal", "injury_mentioned": False})]),
        both([("A", {"plate": "[PLATE_1]", "damage_type": "collision", "injury": True, "incident_date": "2026-07-31", "quotes": {"incident_date": "dün", "damage_type": "çarptım", "injury": "yaralanan oldu"}}), ("D", {"plate": "[PLATE_1]", "policy_no": "POL-2026-00001"})]),
    )
    names = spark.createDataFrame([(n,) for n in STARTER_NAMES], "name string")
    messages = spark.createDataFrame(MESSAGES, "id long, channel string, raw_text string, external_ref string, received_at string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    return messages, answers, names


def test_batch(spark, world):
    rows = {r["id"]: r for r in triage.triage(*world, as_of=F.lit(datetime.date(2026, 8, 1))).collect()}
    assert rows[1]["masked_text"] == "[NAME_1] aradı. Plaka [PLATE_1] dün çarptım, yaralanan oldu."
    assert rows[1]["urgency"] == "critical" and rows[1]["urgency_source"] == "injury_override" and rows[1]["signals"] == ["yaralanan"]
    assert rows[1]["extraction"]["plate"] == "34ABC123" and rows[1]["unverified"] == [] and rows[1]["flags"] == []
    assert rows[2]["extraction"] is None and rows[2]["content_type"] == "info_request"
    assert rows[3]["status"] == "dead_letter" and rows[3]["error"] == "empty message"
    assert rows[4]["unverified"] == ["policy_no"] and "unverified_fields" in rows[4]["decision"]["reasons"]
    steps = [(r["raw_message_id"], r["step"]) for r in triage.audit_rows(triage.triage(*world), F.current_timestamp()).collect()]
    assert (3, "pipeline_error") in steps and (1, "extraction") in steps and (2, "extraction") not in steps


def test_stream(spark, world, tmp_path):
    messages, answers, names = world
    source, target = tmp_path / "in", str(tmp_path / "out")
    messages.where("id <= 2").coalesce(1).write.json(str(source))
    run = lambda: triage.start(spark, str(source), target, answers, names, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    messages.where("id > 2").coalesce(1).write.mode("append").json(str(source))
    run()
    run()  # nothing new
    read = lambda name: triage.output(spark, target, name)
    assert sorted(r["id"] for r in read("claims").collect()) == [1, 2, 4]
    assert [r["id"] for r in read("dead_letter").collect()] == [3]
    assert {r["real_value"] for r in read("mappings").collect()} == {"Ahmet", "34ABC123", "06XYZ99"}
    assert read("audit").where("step = 'pipeline_error'").count() == 1


def test_windows(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    events = spark.createDataFrame([(at(s), "a", float(s)) for s in range(0, 600, 60)], "ts timestamp, k string, v double")
    assert [(r["n"], r["per_second"]) for r in windows.rates(events, "ts", "k").orderBy("begins").collect()] == [(5, 5 / 300), (5, 5 / 300)]
    assert [r["p50"] for r in windows.quantiles(events, "ts", "v").orderBy("begins").collect()] == [120.0, 420.0]
    buckets = spark.createDataFrame([("a", 1.0, 50), ("a", 2.0, 100), ("a", float("inf"), 100), ("b", 1.0, 1), ("b", float("inf"), 100)], "k string, le double, n int")
    assert {r["k"]: r["quantile"] for r in windows.bucket_quantile(buckets, "k", "le", "n").collect()} == {"a": 1.9, "b": 1.0}
    claims, audit = spark.createDataFrame([("in_human_review",), ("approved",)], "status string"), spark.createDataFrame([("approve",), ("reject",), ("approve",)], "step string")
    assert tuple(windows.gauges(claims, audit).first()) == (1, 2, 1)
    assert windows.cost(events, "ts", "v", 0.5, F.lit(at(599))).first()["cost"] == 1350.0


def test_replay(spark, tmp_path):
    spark.range(0, 10, 1, 5).write.parquet(str(tmp_path / "t"))
    got = []
    q = windows.replay(spark, str(tmp_path / "t"), "id long").writeStream.foreachBatch(lambda df, n: got.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(got) == 10 and len(got) == 5


def test_sanity_and_vectors(spark, world, tmp_path):
    """Verdicts are recorded without text, a missing one counts as a leak; claims get vectors, but for a text on which the
    encoder fails."""
    messages, answers, names = world
    verdicts = [("A", {"leak_found": True, "flags": [{"kind": "name", "start": 0, "end": 8}, {"kind": "plate", "start": 5, "end": 900}]}), ("B", {"leak_found": False, "flags": []})]
    sanity = spark.createDataFrame([(k, json.dumps(v)) for k, v in verdicts], "external_ref string, payload string")
    answers = dataclasses.replace(answers, sanity=sanity)
    rows = {r["id"]: r for r in triage.triage(messages, answers, names).collect()}
    assert [(f["kind"], f["span"] and tuple(f["span"])) for f in rows[1]["sanity"]] == [("name", (0, 8)), ("plate", None)]
    assert rows[2]["sanity"] == [] and [f["kind"] for f in rows[4]["sanity"]] == ["other"]
    messages.coalesce(1).write.json(str(tmp_path / "in"))

    def encoder():
        def encode(texts):
            if any("Cam" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    triage.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), answers, names, str(tmp_path / "c"), encoder, 2).awaitTermination()
    read = lambda name: triage.output(spark, f"{tmp_path}/out", name)
    assert [r["claim_id"] for r in read("vectors").collect()] == [1]
    assert sorted(r["id"] for r in read("claims").collect()) == [1, 2, 4]
    assert sorted(r["raw_message_id"] for r in read("audit").where("step = 'masking_sanity'").collect()) == [1, 3, 4]


def test_a_failing_step_stops_one_message(spark, world, tmp_path, monkeypatch):
    messages, answers, names = world

    class Fails(SignalRules):
        def find(self, text):
            if "Kampanya" in text:
                raise ValueError("no")
            return super().find(text)

    everywhere = Fails(terms=(*SignalRules().terms, "kampanya"))
    monkeypatch.setattr(triage, "signals", lambda text: signals(text, everywhere))
    messages.coalesce(1).write.json(str(tmp_path / "in"))
    triage.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), answers, names, str(tmp_path / "c")).awaitTermination()
    read = lambda name: triage.output(spark, f"{tmp_path}/out", name)
    assert sorted(r["id"] for r in read("claims").collect()) == [1, 4]
    assert {r["id"]: r["error"] for r in read("dead_letter").collect()} == {2: "signals failed", 3: "empty message"}


def test_one_message_in_three_batches_is_one_claim(spark, world, tmp_path):
    messages, answers, names = world
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda name: triage.output(spark, target, name)
    for text in ("Plaka 06XYZ99 ve 35KLM77", None, "Ahmet aradı"):
        changed = messages.where("id in (1, 2)").withColumn("raw_text", F.when(F.col("id") == 1, F.lit(text)).otherwise(F.col("raw_text")))
        changed.union(changed.where("id = 1")).coalesce(1).write.mode("append").json(source)
        triage.start(spark, source, target, answers, names, str(tmp_path / "c"), lambda: lambda texts: [[1.0, 2.0] for _ in texts], 2).awaitTermination()
        claims, dead = {r["id"] for r in read("claims").collect()}, {r["id"] for r in read("dead_letter").collect()}
        assert (claims, dead) == (({1, 2}, set()) if text else ({2}, {1}))
        assert [r["claim_id"] for r in read("vectors").collect()] == ([1] if text else [])
    assert [r["real_value"] for r in read("mappings").collect()] == ["Ahmet"]
    assert read("audit").where("raw_message_id = 1 and step = 'masking'").count() == 3


STEPS = ("masking", "masking_sanity", "classification", "extraction", "embedding")


def test_each_step_fails_on_one_message_alone(spark, world, tmp_path):
    """The message goes on without the step, the failure is in the audit without its text, and all others are as ever."""
    _, _, names = world
    rows = [(k, "email", f"Plaka 34ABC12{k} dün çarptım fails-{step}", str(k), f"2026-08-01 10:0{k}:00") for k, step in enumerate((*STEPS, "none"))]
    messages = spark.createDataFrame(rows, "id long, channel string, raw_text string, external_ref string, received_at string")
    says = {
        "masking": lambda t: t.replace("dün", "[DAY_1]"),
        "masking_sanity": lambda t: json.dumps({"leak_found": False, "flags": []}),
        "classification": lambda t: json.dumps({"content_type": "claim", "urgency": "high", "injury_mentioned": False}),
        "extraction": lambda t: json.dumps({"damage_type": "collision", "quotes": {}}),
        "embedding": lambda t: [3.0, 4.0],
    }

    def model(step):
        def each(text):
            if f"fails-{step}" in text.split():
                raise ValueError(f"cannot read {text}")
            return says[step](text)

        return lambda: lambda texts: [each(t) for t in texts]

    answers = triage.Answers(model("classification"), model("extraction"), model("masking_sanity"), model("masking"))
    messages.coalesce(1).write.json(str(tmp_path / "in"))
    triage.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), answers, names, str(tmp_path / "c"), model("embedding"), 2).awaitTermination()
    read = lambda name: triage.output(spark, str(tmp_path / "out"), name)
    claims = {r["id"]: r for r in read("claims").collect()}
    audit = read("audit").where("step like '%_error' and step <> 'pipeline_error'").collect()
    assert sorted((r["raw_message_id"], r["step"], r["detail"]) for r in audit) == [(k, f"{step}_error", '{"kind":"ValueError"}') for k, step in enumerate(STEPS)]
    assert {r["claim_id"] for r in read("vectors").collect()} == {0, 1, 2, 3, 5}
    for k, step in enumerate((*STEPS, "none")):
        row = claims[k]
        assert [f["step"] for f in row["failures"]] == ([step] if step != "none" else [])
        assert ("[DAY_1]" in row["masked_text"]) == (step != "masking") and "34ABC" not in row["masked_text"]
        assert (row["extraction"] is None) == (step == "extraction")
        assert (row["urgency"] == "high") == (step != "classification")
        assert ("masking_sanity_flag" in row["decision"]["advisory_flags"]) == (step == "masking_sanity")
    assert read("dead_letter").count() == 0
