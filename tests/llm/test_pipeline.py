from __future__ import annotations

import corpus_pipeline
from claimloom.llm import decontamination, language_id, mixing
from claimloom.llm.runtime import fold_bucket
from pyspark.sql import functions as F

from tests.llm.test_lines import slow as slow_lines
from tests.llm.test_simhash import slow_similar


def test_against_brute_force(spark, sf):
    """Every stage by plain code over the rows that the one before it kept; the mix by its totals."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.where(fold_bucket(F.col("doc_id"), 4) != 2))
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = language_id.label_texts([r["text"] for r in rows.values()], model)
    kept = {i: rows[i]["text"] for i, (lang, score, _) in zip(rows, labels, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    kept = {i: t for i, t, _, _ in slow_lines(list(kept.items()))}
    groups = slow_similar(list(kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    matcher = decontamination.Matcher(items)
    kept = {i: t for i, t in kept.items() if not matcher.hits(t)}

    folder = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        folder = stage(spark, folder, sf)
        assert folder.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in folder.collect()} == kept

    mixed = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(mixed) <= set(kept)
    sizes: dict = {}
    for i, t in kept.items():
        sizes[rows[i]["source"]] = sizes.get(rows[i]["source"], 0) + len(t.split())
    targets = mixing.water_fill(sizes, sum(sizes.values()), (5, 2, 1), 3)
    for source, target in targets.items():
        taken = sum(r["taken"] for r in mixed.values() if r["source"] == source)
        assert abs(taken - target) <= 0.2 * target
    assert all(r["taken"] == r["copies"] * r["size"] and 1 <= r["copies"] <= 3 for r in mixed.values())


def test_edges(spark, sf):
    docs = spark.createDataFrame(
        [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "12345", None, None, 5), (4, "the and of with", "en", None, 15), (4, "the and of with", "en", None, 15)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for some in (docs, docs.where("false")):
        now = some
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
        assert now.count() <= 1
