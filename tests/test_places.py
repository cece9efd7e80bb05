"""Exact places of values, and names met with and without a join."""

from __future__ import annotations

import random

import pytest

from claimloom.functions import masking
from claimloom.operators import measures


@pytest.mark.parametrize("kind", ["spread", "tied", "one"])
def test_value_at(spark, kind):
    draw = random.Random(3)
    values = {"spread": [draw.gauss(0, 100) for _ in range(3000)], "tied": [float(draw.choice([1, 2, 2, 2, 5])) for _ in range(3000)], "one": [4.0] * 3000}[kind]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for place in (0, 1, 1499, 2850, 2999):
        assert measures.value_at(df, "v", place, len(values), most=20) == sorted(values)[place]


def test_percentiles_narrowed(spark):
    df = spark.createDataFrame([(k % 700, float(k % 97)) for k in range(4000)] + [(None, None)], "e int, v double")
    a, b = (measures.entity_percentile(df, "e", "v", most=m).first() for m in (10, 10**6))
    assert a.percentile == pytest.approx(b.percentile) and a[1:] == b[1:]
    assert measures.nearest_rank(df, "v", most=10).first() == measures.nearest_rank(df, "v").first()
    assert tuple(measures.nearest_rank(df.where("false"), "v").first()) == (0, None, None)


def test_names_by_join_and_in_rows(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Sayın Deniz, Ali ve  (AYŞE) geldi."), (2, "deniz kıyısı"), (3, ""), (4, None), (5, "ali ali Veli")], "id int, text string")
    names = spark.createDataFrame([("ali",), ("Ayşe",), ("deniz",)], "name string")
    rows = lambda: sorted(map(str, masking.mask_names(texts, "id", "text", names).collect()))
    short = rows()
    monkeypatch.setattr(masking, "NAMES_IN_ROW", 0)
    assert rows() == short and "[NAME_3]" in short[0]
