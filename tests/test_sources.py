from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators.joins import Unmatched
from claimloom.operators.views import FLAT_COLUMNS, claims_flat, retrieved
from claimloom.sources import files, generator


def test_jsonl(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": 1, "t": "ç"}\n\n{"id": 2}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(good), "id int, t string").orderBy("id").collect()] == [(1, "ç"), (2, None)]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(files.Malformed, match="b.jsonl"):
        files.read_jsonl(spark, str(bad), "id int")
    assert files.line_number(spark, str(bad), '{"id": ') == 2
    assert files.read_jsonl(spark, str(bad), "id int", strict=False).count() == 2
    files.write_jsonl(files.read_jsonl(spark, str(good), "id int, t string"), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id int, t string").count() == 2


def test_runs(spark, tmp_path):
    records = spark.createDataFrame([("a", True)], "id string, hit boolean")
    files.write_run(records, str(tmp_path / "run"), {"seed": 1})
    back, meta = files.read_run(spark, str(tmp_path / "run"))
    assert back.collect() == records.collect() and meta == {"seed": 1}
    for document, meta in (([{"id": "a"}], {}), ({"meta": {"m": 1}, "records": [{"id": "a"}]}, {"m": 1})):
        path = tmp_path / "r.json"
        path.write_text(json.dumps(document, indent=1))
        rows, found = files.read_run_json(spark, str(path), "id:string")
        assert [r["id"] for r in rows.collect()] == ["a"] and found == meta


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.txt").write_text(" Ali \n\nAyşe\nAli\n")
    assert sorted(r[0] for r in files.read_dictionary(spark, str(tmp_path / "d.txt")).collect()) == ["Ali", "Ayşe"]
    (tmp_path / "p.txt").write_text("dün|1\nbugün|0\nno number\n")
    assert sorted(map(tuple, files.read_pairs(spark, str(tmp_path / "p.txt")).collect())) == [("bugün", 0), ("dün", 1)]
    assert files.read_scenario('{"name": "x", "phases": []}')["name"] == "x"


def test_recorded(spark, tmp_path):
    line = lambda m, g: json.dumps({"response_model": m, "gt_id": g, "tier": "cheap", "payload": {"a": g}})
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join([line("A", "*"), line("A", "1")]))
    assert files.read_recorded(spark, str(path)).count() == 2
    path.write_text("\n".join([line("A", "*"), line("A", "1"), line("A", "1")]))
    with pytest.raises(files.Malformed, match="twice"):
        files.read_recorded(spark, str(path))
    path.write_text(line("A", "1"))
    with pytest.raises(files.Malformed, match=r"no answer \*"):
        files.read_recorded(spark, str(path))
    found = files.fingerprint(spark, str(path))
    files.require_same_corpus({"r": found.first()["sha256"]}, found)
    with pytest.raises(Unmatched):
        files.require_same_corpus({"r": "0"}, found)


AMOUNTS = [('12500.5', 12500.5), ('"12500.5"', 12500.5), ("1e25", 1e25), ('"1.250,50 TL"', None), ('"abc"', None), ('""', None)]
FLAGS = [("true", True), ('"True"', True), ("false", False), ('"FALSE"', False), ('"evet"', None), ("null", None)]


def test_flat_view(spark):
    messages = spark.createDataFrame([(1, "masked", "2026-08-01")], "id int, status string, received_at string")
    data = [f'{{"extraction": {{"estimated_amount": {a}, "injury": {f}, "incident_date": "2026-07-15", "incident_location": {{"city": "İzmir"}}}}}}' for (a, _), (f, _) in zip(AMOUNTS, FLAGS, strict=True)]
    data += ["{}", None, "no json"]
    claims = spark.createDataFrame([(k, 1, d) for k, d in enumerate(data)], "id int, raw_message_id int, data string")
    claims = claims.withColumns({c: F.lit("x") for c in ("channel", "content_type", "urgency", "status", "created_at", "updated_at")})
    flat = claims_flat(claims, messages)
    assert flat.columns == FLAT_COLUMNS
    rows = {r["id"]: r for r in flat.collect()}
    for k, ((_, amount), (_, flag)) in enumerate(zip(AMOUNTS, FLAGS, strict=True)):
        assert (None if rows[k]["estimated_amount"] is None else float(rows[k]["estimated_amount"])) == amount
        assert rows[k]["injury"] is flag and rows[k]["city"] == "İzmir" and rows[k]["incident_date"].isoformat() == "2026-07-15" and rows[k]["counterparty_exists"] is None
    assert all(rows[k]["city"] is None for k in (6, 7, 8))
    vectors = spark.createDataFrame([(0, [1.0]), (1, [0.0])], "claim_id int, embedding array<double>")
    assert retrieved(flat, vectors, urgency="x").count() == 2 and retrieved(flat, vectors, status="y").count() == 0


def test_generator(spark):
    one, two = generator.ground_truth(spark, 400).orderBy("gt_id").collect(), generator.ground_truth(spark, 400).repartition(7).orderBy("gt_id").collect()
    assert one == two and one != generator.ground_truth(spark, 400, seed=7).orderBy("gt_id").collect()
    for r in one:
        e = r["expected"]
        assert not e.injury or e.urgency == "critical"
        assert e.counterparty_exists == (e.damage_type == "collision" and e.content_type == "claim")
        assert (e.plate is None) == (e.content_type != "claim")
    share = sum(r["expected"].content_type == "claim" for r in one) / 400
    assert 0.85 < share < 0.95
    texts = {r["gt_id"]: r for r in generator.render_texts(generator.ground_truth(spark, 400)).collect()}
    for r in one:
        if r["expected"].plate:
            assert r["expected"].plate in texts[r["gt_id"]]["text"] and "None" not in texts[r["gt_id"]]["text"] and "{}" not in texts[r["gt_id"]]["text"]
    assert {r["expected"].incident_location.city for r in one if r["expected"].plate} == {c for c, *_ in generator.CITIES}
    told = [t["text"] for t in texts.values()]
    assert all(sum(m.split("{}")[0] in t for t in told) for m in generator.MAILS) and sum(any(c in t for t in told) for c in generator.CALLS) == 0
    assert sum(any(f"Hasar: {v[3]}" in t for t in told) for v in generator.PHRASES.values()) >= 6
    assert [r["text"] for r in generator.render_texts(generator.ground_truth(spark, 400).repartition(5)).orderBy("gt_id").collect()] == [texts[k]["text"] for k in sorted(texts)]


def test_run_as_one_document(spark, tmp_path):
    path = str(tmp_path / "run")
    files.write_run_json(spark.createDataFrame([(1, "şık"), (2, None)], "id int, text string"), path, {"model": "x", "at": "gün"})
    rows, meta = files.read_run_json(spark, path, "id int, text string")
    assert sorted(map(tuple, rows.collect())) == [(1, "şık"), (2, None)] and meta == {"model": "x", "at": "gün"}
    files.write_run_json(spark.createDataFrame([], "id int"), path, {})
    assert files.read_run_json(spark, path, "id int")[0].count() == 0


def test_report(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"metrics": []}')
    bad.write_text("[1")
    assert files.read_report(spark, str(good)) == '{"metrics": []}'
    assert files.read_report(spark, str(bad)) is None and files.read_report(spark, str(tmp_path / "none")) is None


def test_seed(spark, tmp_path):
    messages = spark.range(10).selectExpr("id", "10 - id AS place")
    seeded = files.load_first(messages, "place", 3, str(tmp_path / "in"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "in")).collect()) == [7, 8, 9]
    claims = spark.createDataFrame([(7, "approved"), (8, "received")], "id long, status string")
    assert sorted(r.id for r in files.unfinished(seeded, claims, "id", ("approved", "archived")).collect()) == [8, 9]
