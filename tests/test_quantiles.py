"""Exact places from summaries, numbers by ranges, line numbers and the bound of a share."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import measures, quantiles
from claimloom.operators.numbering import numbered
from claimloom.sources import files
from claimloom.streaming import windows

SHARES = (0.0001, 0.01, 0.5, 0.95, 0.999, 1.0)


def values(kind, n=4000, seed=5):
    draw = random.Random(seed)
    return {
        "spread": lambda: [draw.gauss(0, 1) * 10 ** draw.randint(-300, 300) for _ in range(n)],
        "close": lambda: [1 + draw.randrange(1000) * 2.0**-52 for _ in range(n)],
        "tied": lambda: [float(draw.choice([-1, 0, 0, 0, 2])) for _ in range(n)],
        "one": lambda: [7.25] * n,
        "odd": lambda: [draw.choice([math.nan, math.inf, -math.inf, -0.0, 5e-324, 1.7e308, -1.7e308]) for _ in range(n)],
        "single": lambda: [3.0],
    }[kind]()


@pytest.mark.parametrize("kind", ["spread", "close", "tied", "one", "odd", "single"])
def test_quantiles(spark, kind):
    data = values(kind)
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double")
    row = quantiles.quantiles(df, [], "v", {f"p{k}": quantiles.disc(s) for k, s in enumerate(SHARES)}).first()
    ordered = sorted(data, key=lambda v: (math.isnan(v), v))
    for found, share in zip(row, SHARES, strict=True):
        expected = ordered[max(1, math.ceil(len(data) * share)) - 1]
        assert found == expected or math.isnan(found) and math.isnan(expected)


def test_bins_never_fall(spark):
    data = sorted(values("spread") + values("close") + [0.0, math.inf, -math.inf])
    bins = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(data)], "k int, v double").orderBy("k").select(quantiles.bin_of(F.col("v"))).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("few", [quantiles.FEW, 0])
def test_merged_summaries_of_many_keys(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", None]), day, draw.expovariate(0.01)) for day in range(6) for _ in range(300)] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    daily = quantiles.summary(df, ["k", "day"], "v")
    half = (F.col("day") / 3).cast("int").alias("half")
    over = quantiles.merged(daily.withColumn("half", half), ["k", "half"])
    ranks = {"p50": quantiles.disc(0.5), "p95": quantiles.nearest_rank(0.95)}
    found = {(r["k"], r["half"]): (r["p50"], r["p95"]) for r in quantiles.at_ranks(df.withColumn("half", half), over, ["k", "half"], "v", ranks).collect()}
    for k in ("a", "b", None):
        for h in (0, 1):
            own = sorted(v for kk, d, v in rows if kk == k and d // 3 == h)
            assert found[k, h] == (own[math.ceil(len(own) / 2) - 1], own[min(len(own) - 1, int(len(own) * 0.95))])
    assert len(found) == 6
    assert quantiles.quantiles(df.where("false"), ["k"], "v", ranks).count() == 0


def test_windows_of_more_values_than_an_estimate_holds(spark):
    df = spark.range(60_000).select(F.expr("timestamp_seconds(id % 2 * 300)").alias("ts"), (F.xxhash64("id") / 1e9).alias("v"))
    found = {r["begins"].timestamp(): (r["p50"], r["p95"]) for r in windows.quantiles(df, "ts", "v").collect()}
    held: dict = {}
    for ts, v in df.collect():
        held.setdefault(ts.timestamp(), []).append(v)
    assert found == {t: (sorted(vs)[math.ceil(len(vs) * 0.5) - 1], sorted(vs)[math.ceil(len(vs) * 0.95) - 1]) for t, vs in held.items()}


def test_nearest_rank_in_one_aggregate(spark):
    data = [float(v) for v in range(101)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([(v,) for v in data], "v double")
    assert tuple(measures.nearest_rank(df, "v").first()) == tuple(measures.nearest_rank(df, "v", most=5).first()) == (101, 95.0, 50.0)


def test_numbers(spark):
    draw = random.Random(3)
    rows = [(k, draw.randrange(50)) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    found = numbered(df, F.desc("v"), "id")
    assert sorted((r["position"], r["id"]) for r in found.collect()) == [(n, i) for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert numbered(df.where("false"), "id").count() == 0


def test_line_numbers_of_a_file_of_several_splits(spark, tmp_path):
    lines = [json.dumps({"id": k, "pad": "x" * 50}) if k % 10 else "" for k in range(5000)]
    lines[3777], lines[4100] = '{"id": ', "{also bad"
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"id": k}) for k in range(3)))
    (tmp_path / "b.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        with pytest.raises(files.Malformed, match=r"b\.jsonl, line 3778: \{\"id\": "):
            files.read_jsonl(spark, str(tmp_path), "id long")
        assert files.read_jsonl(spark, str(tmp_path), "id long", strict=False).where("id = 4999").count() == 1
        assert files.line_number(spark, str(tmp_path), "{also bad") == 4101 and files.line_number(spark, str(tmp_path), "nowhere") is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def slow_bound(k, n, alpha=0.05):
    ways = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k, n + 1)]
    low, high = 0.0, k / n
    for _ in range(60):
        p = (low + high) / 2
        above = math.fsum(math.exp(w + i * math.log(p) + (n - i) * math.log1p(-p)) for i, w in enumerate(ways, k)) if p else 0
        low, high = (low, p) if above > alpha else (p, high)
    return low


def test_bound_of_a_share(spark):
    rows = [(k, n) for n in (2, 3, 10, 65, 100, 1000, 5000) for k in sorted({1, 2, n // 3, n // 2, n - 2, n - 1}) if 0 < k < n]
    found = spark.createDataFrame(rows, "h long, n long").select(measures.lower_bound(F.col("h"), F.col("n"))).collect()
    for (k, n), r in zip(rows, found, strict=True):
        assert r[0] == pytest.approx(slow_bound(k, n), abs=1e-9), (k, n)
    large = spark.createDataFrame([(900_000_000, 1_000_000_000), (999_999_999, 1_000_000_000), (0, 5), (6, 5), (None, 5), (-1, 5), (0, 0)], "h long, n long")
    a, b, *rest = (r[0] for r in large.select(measures.lower_bound(F.col("h"), F.col("n"))).collect())
    assert a == pytest.approx(0.9 - 1.6448536 * math.sqrt(0.09 / 1e9), abs=1e-8)
    assert b == pytest.approx(1 - 4.7438645e-9, abs=1e-12)  # n times what is missing is the 95 % point of a gamma distribution with shape 2
    assert rest == [0.0, None, None, None, None]
