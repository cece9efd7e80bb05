from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.operators import measures, ranking, rules
from claimloom.operators.joins import Unmatched, in_order_of, lookup_with_default, strict_join, upsert

FIELDS = "plate string, policy_no string, incident_date string, estimated_amount string, damage_type string, injury boolean, counterparty_exists boolean"
CLEAN = ("34ABC123", "POL-2026-00001", "2026-07-01", "1200.5", "glass", False, False)


@pytest.fixture(scope="module")
def fired(spark):
    def of(values, urgency="normal", content="claim", signals=()):
        df = spark.createDataFrame([(values, urgency, content, list(signals))], f"x struct<{FIELDS.replace(' string', ':string').replace(' boolean', ':boolean')}>, urgency string, content string, signals array<string>")
        flags = rules.validation_flags(F.col("x"), F.col("urgency"), F.col("content"), F.col("signals"), F.lit(datetime.date(2026, 8, 1)))
        return [f.rule for f in df.select(flags.alias("f")).first()["f"]]

    return of


def but(**changes):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, CLEAN, strict=True))


@pytest.mark.parametrize(
    ("values", "how", "names"),
    [
        (CLEAN, {}, []), (but(plate="34A1"), {}, ["invalid_plate_format"]), (but(policy_no="X"), {}, ["invalid_policy_no_format"]), (but(incident_date="dün"), {}, ["invalid_date_format"]),
        (but(incident_date="2026-08-02"), {}, ["future_incident_date"]), (but(estimated_amount="-1"), {}, ["invalid_estimated_amount"]), (but(estimated_amount="çok"), {}, ["invalid_estimated_amount"]),
        (CLEAN, {"urgency": "low"}, ["invalid_urgency"]), (CLEAN, {"urgency": None}, ["invalid_urgency"]), (but(damage_type="x"), {}, ["invalid_damage_type"]), (CLEAN, {"content": "spam"}, ["invalid_content_type"]),
        (CLEAN, {"signals": ["yaralı"]}, ["injury_keyword_mismatch"]), (but(injury=True), {}, ["injury_not_critical"]), (but(injury=True), {"urgency": "critical", "signals": ["yaralı"]}, []),
        (but(counterparty_exists=True, damage_type="single_vehicle"), {}, ["counterparty_single_vehicle_conflict"]), (but(plate=None, incident_date=None), {}, ["claim_missing_core_fields"]),
    ],
)
def test_validation(fired, values, how, names):
    assert fired(values, **how) == names


def test_classification(spark):
    rows = [("claim", "normal", False, []), ("claim", "high", True, []), ("claim", "critical", True, ["a"]), ("claim", "normal", None, ["a"]), (None, None, None, ["a"]), (None, None, None, [])]
    df = spark.createDataFrame(rows, "c string, u string, f boolean, s array<string>")
    found = [tuple(r[0]) for r in df.select(rules.classify(F.col("c"), F.col("u"), F.col("f"), F.col("s"))).collect()]
    assert found == [("claim", "normal", "llm"), ("claim", "critical", "injury_override"), ("claim", "critical", "llm"), ("claim", "critical", "injury_override"), ("claim", "critical", "injury_override"), ("claim", "normal", "fallback")]


def test_gate(spark):
    df = spark.range(1).select(rules.flags_of([("a", "x", F.lit(True), F.lit("")), ("b", "invalid_policy_no_format", F.lit(True), F.lit("")), ("c", "x", F.lit(True), F.lit("")), ("d", "y", F.lit(None).cast("boolean"), F.lit(""))]).alias("flags"))
    none = F.array().cast("array<string>")
    row = df.select(rules.approval(F.lit("irrelevant"), F.lit("critical"), F.col("flags"), F.array(F.lit("plate")), F.lit(True), F.lit(False)).alias("d"), rules.approval(F.lit("claim"), F.lit("high"), F.filter("flags", lambda f: f["rule"] != "x"), none, F.lit(True), F.lit(True), True).alias("e")).first()
    assert row["d"].asDict() == {"approved": False, "reasons": ["auto_approve_disabled", "not_a_claim", "critical_urgency", "no_extraction", "blocking_validation_flags", "unverified_fields"], "blocking_flags": ["x"], "advisory_flags": ["invalid_policy_no_format", "masking_sanity_flag"]}
    assert row["e"]["approved"] and row["e"]["advisory_flags"] == ["invalid_policy_no_format", "masking_sanity_flag"]


def test_sanity(spark):
    df = spark.createDataFrame([((True, [("name", 0, 3), ("phone", 2, 99)]), "abcdef"), (None, "abc")], "v struct<leak_found:boolean,flags:array<struct<kind:string,start:int,end:int>>>, t string")
    a, b = (r[0] for r in df.select(rules.sanity_flags(F.col("v"), F.col("t"))).collect())
    assert [(f.kind, f.span and tuple(f.span)) for f in a] == [("name", (0, 3)), ("phone", None)]
    assert [(f.kind, f.span) for f in b] == [("other", None)]


def test_edit_and_transition(spark):
    df = spark.createDataFrame([(1, ("a", 1.0)), (2, ("b", -1.0))], "id int, x struct<plate:string,amount:double>")
    rows = {r["id"]: r for r in rules.edit(df, "x", {"plate": F.lit("b"), "amount": F.lit(5.0)}, {"amount": F.col("x.amount") > 0}).collect()}
    assert [c.field for c in rows[1].changes] == ["plate", "amount"] and rows[2].changes == [] and rows[2].refused == ["amount"]
    with pytest.raises(ValueError, match="not editable"):
        rules.edit(df, "x", {"other": F.lit(1)})
    claims = spark.createDataFrame([(1, "in_human_review", None), (2, "approved", None), (3, "in_human_review", None)], "id int, status string, updated_at timestamp")
    decisions = spark.createDataFrame([(1, "approve"), (2, "reject"), (3, "reject"), (9, "approve")], "claim_id int, action string")
    after, audit = rules.transition(claims, decisions, F.lit("2026-01-01").cast("timestamp"))
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "approved", 2: "approved", 3: "archived"}
    assert {r["claim_id"]: r["step"] for r in audit.collect()} == {1: "approve", 2: "refused", 3: "reject"}


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, c string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, c string")
    assert strict_join(a, b.withColumn("d", F.lit(1)), "k", ("c",)).count() == 2
    with pytest.raises(Unmatched, match="1 rows only left"):
        strict_join(a, b.where("k = 1").select("k"), "k")
    with pytest.raises(Unmatched, match="1 differ"):
        strict_join(a, b.withColumn("c", F.lit("x")), "k", ("c",))
    ids = spark.createDataFrame([(2, 0), (1, 1)], "k int, position int")
    assert [r["k"] for r in in_order_of(a, "k", ids).collect()] == [2, 1]
    with pytest.raises(Unmatched):
        in_order_of(a, "k", spark.createDataFrame([(7, 0)], "k int, position int"))
    answers = spark.createDataFrame([("1", "own"), ("*", "any")], "k string, payload string")
    assert sorted(r["payload"] for r in lookup_with_default(a.withColumn("k", F.col("k").cast("string")), answers, "k").collect()) == ["any", "own"]
    with pytest.raises(ValueError, match="blank"):
        upsert(a.withColumn("t", F.lit(1)), spark.createDataFrame([(1, " ", 2)], "k int, c string, t int"), "k", "t", "c")


def test_ranking(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    asked = F.array(F.lit(1.0), F.lit(0.0))
    assert [(r["id"], r["score"]) for r in ranking.nearest(df, asked, "v", "id", 2).collect()] == [(1, 1.0), (2, 0.0)]
    assert ranking.nearest(df.where("false"), asked, "v", "id").count() == 0
    with pytest.raises(ValueError, match="limit"):
        ranking.page(df, F.asc("id"), limit=101)
    with pytest.raises(ValueError, match="fewer"):
        ranking.stratified_sample(df.withColumn("s", F.lit(1)), "s", "id", 9)


def test_measures(spark):
    bound = spark.createDataFrame([(64, 65), (0, 5), (5, 5), (1, 0)], "h int, n int").select(measures.lower_bound(F.col("h"), F.col("n")).alias("b"))
    values = [r["b"] for r in bound.collect()]
    assert values[0] == pytest.approx(0.9291, abs=1e-4) and values[1] == 0 and values[2] == pytest.approx(0.05 ** 0.2) and values[3] is None
    empty = spark.createDataFrame([], "v double")
    assert tuple(measures.nearest_rank(empty, "v").first()) == (0, None, None)
    for n in (1, 2, 3, 20, 21):
        values = [float(k * k % 17) for k in range(n)]
        row = measures.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
        assert tuple(row) == (n, sorted(values)[min(n - 1, int(n * 0.95))], sorted(values)[n // 2])
    status = spark.createDataFrame([(0.9, 0.8, "gte"), (0.7, 0.8, "gte"), (0.01, 0.07, "lte"), (None, 0.5, "gte")], "v double, t double, d string")
    assert [r[0] for r in status.select(measures.metric_status(F.col("v"), F.col("t"), F.col("d"))).collect()] == ["pass", "fail", "pass", "unmeasured"]


def test_field_comparison(spark):
    df = spark.createDataFrame([("34 ABC 1", "34abc1", None, False, "12.500,75 TL", "12500.75", "İzmir'de", "izmir")], "a string, b string, c boolean, d boolean, e string, f string, g string, h string")
    same = measures.equal_when_normal
    row = df.select(same("plate", F.col("a"), F.col("b")), same("injury", F.col("c"), F.col("d")), same("estimated_amount", F.col("e"), F.col("f")), same("damage_type", F.col("g"), F.col("h")), same("policy_no", F.col("a"), F.col("h"))).first()
    assert tuple(row) == (True, True, True, True, False)
