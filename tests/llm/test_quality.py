from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from claimloom.llm import quality, queries


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality_classifier(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").toPandas()
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"])
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
    labelled = rows.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = labelled[labelled["held_out"]]
    assert auc(held["quality"].to_numpy(), held["score"].to_numpy()) > 0.95
    assert (held["predicted"] == held["quality"]).mean() > 0.93


def slow_margin(trees, x):
    total = trees.base
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return total


def test_flat_traversal_agrees_with_walking():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 6))
    x[:, 3] = draw.integers(0, 3, 600)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 3] == 1)).astype(float)
    trees = quality.fit_trees(x, y, rounds=80)
    assert trees.margins(x) == pytest.approx([slow_margin(trees, r) for r in x])
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.95
    assert len(trees.roots) == 80


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0, 0]])
def test_one_class(y):
    trees = quality.fit_trees(np.zeros((len(y), 3)), np.array(y, float))
    assert 0 < trees.scores(np.zeros((2, 3)))[0] < 1


def test_statistics():
    assert quality.statistics(None) == quality.statistics("  \n") == (0.0,) * len(quality.FEATURES)
    found = dict(zip(quality.FEATURES, quality.statistics("AB! ab ab 12\nab\nab"), strict=True))
    assert found["repeated_next"] == pytest.approx(2 / 6) and found["exclaims"] == pytest.approx(1 / 18)
    assert found["distinct_words"] == pytest.approx(3 / 6) and found["repeated_lines"] == pytest.approx(1 / 3)
    assert all(np.isfinite(quality.statistics("x" * 300_000 + " Äß|" * 50_000)))


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate([None, "", "good text here", "BAD!! BAD!!"] * 10)] + [(1, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, None), (3, 0), (None, 1), (999, 0), (3, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert docs.select(quality.quality_score(docs["text"], model).alias("s")).where("s between 0 and 1").count() == 41
    assert len(quality.fit(docs, labels.where("false")).roots) == 0
    assert docs.where("false").select(quality.quality_score(docs["text"], model)).count() == 0


def test_query_against_plain_descent(spark, sf):
    """The query's score of every document is what each tree gives, node by node, with the model fitted again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    taught = [i for (i,) in docs.select("doc_id").collect() if fold(i)]
    model = quality.fit(docs.where(F.col("doc_id").isin(taught)), spark.read.parquet(f"{sf}/labels.parquet").where(F.col("doc_id").isin(taught)))

    def slow(text):
        x, margin = quality.statistics(text), model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if x[model.feature[node]] <= model.threshold[node] else model.right[node]
            margin += model.value[node]
        return 1 / (1 + math.exp(-margin))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = queries.op1_quality_classifier(spark, sf).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        assert abs(r["score"] - slow(texts[r["doc_id"]])) < 1e-9
        assert r["held_out"] == (fold(r["doc_id"]) == 0) and r["predicted"] == (r["score"] >= 0.3)
