from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import prefix_forest, queries


def exact(ids, x, asking, k):
    out = {}
    for q in asking:
        i = int(np.flatnonzero(ids == q)[0])
        score = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    found: dict = {}
    for r in queries.op7_nearest_neighbours(spark, sf).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = 0
    for q, some in found.items():
        some.sort()
        assert [r for r, _, _ in some] == list(range(1, len(some) + 1)) and len(some) == 20
        known = {int(j): float((x[j == ids][0] * x[q == ids][0]).sum()) for _, j, _ in some}
        assert [s for _, _, s in some] == pytest.approx([known[j] for _, j, _ in some], abs=1e-12)
        hits += len({j for _, j, _ in some} & {j for j, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_where_it_must_search(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(6000, 32)).astype(np.float32)
    x[::3] = x[0] + 0.05 * draw.normal(size=(2000, 32))  # a third of all rows in one dense group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = prefix_forest.nearest(vectors, F.col("vec_id") % 100 == 0, k=10, least=500).collect()
    want = exact(np.arange(6000), x.astype(float), range(0, 6000, 100), 10)
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {j for j, _ in w}) / 10 for q, w in want.items()]) >= 0.9


def test_ties_of_large_products(spark):
    """Equal products of a million and more are all looked at: ties fall to the smaller id."""
    draw = np.random.default_rng(6)
    x = np.round(draw.normal(size=(400, 8)), 1) * 1e7
    x[1:200] = x[1]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(np.arange(400), x, range(0, 400, 20), 10)
    got: dict = {}
    for r in prefix_forest.nearest(vectors, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in want.items()}


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, [float("inf"), 0.0]), (None, [1.0, 0.0]), (20, [-1.0, 0.0]), (40, None), (60, [])]
    vectors = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    found = sorted(tuple(r) for r in prefix_forest.nearest(vectors, F.col("vec_id") % 20 == 0, k=3).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (20, 1, 3, 0.0), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    assert prefix_forest.nearest(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert prefix_forest.nearest(vectors, F.lit(False)).count() == 0


def test_codes():
    codes = prefix_forest.Codes(8, 2, 5, 1)
    x = np.random.default_rng(0).normal(size=(50, 8)).astype(np.float32)
    code = codes.of(x, 1)[:, 0]
    assert (codes.of(x, 1, 3)[:, 0] == code).all()
    low, high = codes.bounds(code, 1)
    shared = code >> codes.bits * (codes.symbols - 1)
    assert all(((code >= a) & (code < b)).tolist() == (shared == s).tolist() for a, b, s in zip(low, high, shared, strict=True))
    low, high = codes.bounds(code, 0)
    assert (low == 0).all() and (high > code.max()).all()


def test_scores_of_doubles_are_exact(spark):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((60, 8)) + 1e-9
    found = prefix_forest.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") < 5, k=3).collect()
    assert len(found) == 15 and all(abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-13 for r in found)
