"""Quality measures, over documents and their labels in the place of claims and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.vectors import ratio
from claimloom.operators import measures
from claimloom.operators.rules import approval, flags_of
from claimloom.plans.registry import query, table

#: The rules that stand in for validation, on a document's columns, as SQL of both engines.
RULE_SQL = {
    "too_short": "n_chars < 200",
    "shouting": "text LIKE '%!!%'",
    "symbols": "text LIKE '%***%'",
    "not_english": "lang <> 'en'",
}
RULES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULE_SQL.items()) + "], lambda x: x IS NOT NULL)"
RECORDS_SQL = f"records AS (SELECT doc_id, lang, source, quality, toxic, {RULES_SQL} AS rules FROM documents JOIN labels USING (doc_id))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the flags of the rules."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    flags = flags_of([("text", name, F.expr(condition), F.lit(name)) for name, condition in RULE_SQL.items()])
    return joined.select("doc_id", "lang", "source", "quality", "toxic", flags.alias("flags"))


def decision(advisory: tuple[str, ...] = ("not_english",)) -> Column:
    none = F.array().cast("array<string>")
    urgency = F.when(F.col("toxic") == 1, "critical").otherwise("normal")
    return approval(F.lit("claim"), urgency, F.col("flags"), none, F.lit(False), F.lit(True), True, advisory)


@query(f"WITH {RECORDS_SQL} SELECT doc_id, unnest(rules) AS rule FROM records")
def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.explode("flags.rule").alias("rule"))


@query(f"""
    WITH {RECORDS_SQL} SELECT doc_id, toxic <> 1 AND len(list_filter(rules, lambda x: x <> 'not_english')) = 0 AS approved,
    array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'critical_urgency' END, CASE WHEN len(list_filter(rules, lambda x: x <> 'not_english')) > 0 THEN 'blocking_validation_flags' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM records
""")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = records(spark, sf_dir).select("doc_id", decision().alias("d"))
    return d.select("doc_id", "d.approved", F.array_join("d.reasons", ",").alias("reasons"))


@query(f"""
    WITH {RECORDS_SQL}, d AS (SELECT toxic <> 1 AND len(list_filter(rules, lambda x: x <> 'not_english')) = 0 AS approved, quality = 1 AS correct FROM records)
    SELECT count(*) AS records, count(*) FILTER (WHERE approved) AS approved, count(*) FILTER (WHERE approved AND correct) AS correct_approved,
           round(count(*) FILTER (WHERE approved) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE approved AND correct) / nullif(count(*) FILTER (WHERE approved), 0), 6) AS precision FROM d
""")
def gate_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.gate_measure(records(spark, sf_dir).withColumn("d", decision()), F.col("d"), F.col("quality") == 1)
    return found.withColumns({"coverage": F.round("coverage", 6), "precision": F.round("precision", 6)})


CANDIDATES = {"none": (), "languages": ("not_english",), "languages_and_length": ("not_english", "too_short")}


@query(
    f"WITH {RECORDS_SQL}, d AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS candidate, toxic <> 1 AND len(list_filter(rules, lambda x: NOT list_contains([{', '.join(map(repr, rules))}]::VARCHAR[], x))) = 0 AS approved, quality = 1 AS correct FROM records"
        for name, rules in CANDIDATES.items()
    )
    + """) SELECT candidate, count(*) AS records, count(*) FILTER (WHERE approved) AS approved, count(*) FILTER (WHERE approved AND correct) AS correct_approved,
    round(count(*) FILTER (WHERE approved) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE approved AND correct) / nullif(count(*) FILTER (WHERE approved), 0), 6) AS precision FROM d GROUP BY candidate"""
)
def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    found = measures.gate_sweep(
        records(spark, sf_dir), CANDIDATES, content_type=F.lit("claim"), urgency=F.when(F.col("toxic") == 1, "critical").otherwise("normal"),
        flags=F.col("flags"), unverified=none, sanity=F.lit(False), extracted=F.lit(True), correct=F.col("quality") == 1,
    )
    return found.withColumns({"coverage": F.round("coverage", 6), "precision": F.round("precision", 6)})


@query(f"WITH {RECORDS_SQL} SELECT rule, count(*) AS records FROM (SELECT doc_id, unnest(rules) AS rule FROM records) GROUP BY rule")
def rules_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.rules_per_record(records(spark, sf_dir), F.col("flags"))


@query(f"""
    WITH {RECORDS_SQL}, r AS (SELECT unnest([CASE WHEN toxic = 1 THEN 'critical_urgency' END, CASE WHEN len(list_filter(rules, lambda x: x <> 'not_english')) > 0 THEN 'blocking_validation_flags' END]) AS reason FROM records)
    SELECT reason, count(*) AS records FROM r WHERE reason IS NOT NULL GROUP BY reason
""")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.gate_reasons(records(spark, sf_dir).withColumn("d", decision()), F.col("d"))


PREDICTED_SQL = f"WITH {RECORDS_SQL}, p AS (SELECT *, CASE WHEN len(list_filter(rules, lambda x: x <> 'not_english')) = 0 THEN 1 ELSE 0 END AS predicted FROM records)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocking = F.size(F.filter("flags.rule", lambda r: r != "not_english"))
    return records(spark, sf_dir).withColumn("predicted", F.when(blocking == 0, 1).otherwise(0))


CLASS_SQL = PREDICTED_SQL + """,
    l AS (SELECT unnest([quality, predicted]) AS label, unnest([1, 0]) AS s, unnest([0, 1]) AS d, quality = predicted AS same FROM p),
    c AS (SELECT label::VARCHAR AS label, sum(s)::BIGINT AS support, sum(d)::BIGINT AS predicted, sum(CASE WHEN same THEN s ELSE 0 END)::BIGINT AS tp FROM l GROUP BY 1),
    f AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM c),
    g AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM f)"""


@query(CLASS_SQL + " SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM g")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.class_report(predicted(spark, sf_dir), "quality", "predicted")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(CLASS_SQL + " SELECT round(avg(f1), 6) AS macro_f1, round(sum(tp) / sum(support), 6) AS accuracy, sum(support)::BIGINT AS scored FROM g")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.macro_f1(measures.class_report(predicted(spark, sf_dir), "quality", "predicted"))
    return found.withColumns({"macro_f1": F.round("macro_f1", 6), "accuracy": F.round("accuracy", 6)})


@query(PREDICTED_SQL + " SELECT quality::VARCHAR || ' -> ' || predicted::VARCHAR AS pair, count(*) AS n FROM p WHERE quality <> predicted GROUP BY pair")
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.confusions(predicted(spark, sf_dir), "quality", "predicted")


@query(f"""
    WITH {RECORDS_SQL}, s AS (SELECT lang AS channel, unnest(['quality', 'toxic']) AS field, unnest([quality = 1, toxic = 0]) AS hit FROM records)
    SELECT CASE WHEN grouping(channel) = 1 AND grouping(field) = 1 THEN 'all' WHEN grouping(field) = 1 THEN 'channel' ELSE 'field' END AS scope,
           coalesce(channel, field, 'all') AS name, count(*) FILTER (WHERE hit) AS hits, count(*) AS total, round(count(*) FILTER (WHERE hit) / count(*), 6) AS accuracy
    FROM s GROUP BY GROUPING SETS ((channel), (field), ())
""")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array(F.struct(F.lit("quality").alias("field"), (F.col("quality") == 1).alias("hit")), F.struct(F.lit("toxic").alias("field"), (F.col("toxic") == 0).alias("hit")))
    scored = records(spark, sf_dir).select(F.col("lang").alias("channel"), F.inline(hits))
    return measures.field_accuracy(scored).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {RECORDS_SQL} SELECT sum(len(rules))::BIGINT AS unsupported, sum(2 + len(rules))::BIGINT AS filled, round(sum(len(rules)) / sum(2 + len(rules)), 6) AS rate FROM records")
def unsupported_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.col("flags.rule")
    found = measures.unsupported_rate(records(spark, sf_dir), rule, F.concat(F.array(F.lit("a"), F.lit("b")), rule))
    return found.withColumn("rate", F.round("rate", 6))


@query(f"""
    WITH {RECORDS_SQL}, x AS (SELECT CASE WHEN quality = 0 THEN ['symbols', 'shouting'] ELSE []::VARCHAR[] END AS e, rules AS a FROM records),
    c AS (SELECT sum(len(list_intersect(e, a)))::BIGINT AS tp, sum(len(list_filter(a, lambda v: NOT list_contains(e, v))))::BIGINT AS fp, sum(len(list_filter(e, lambda v: NOT list_contains(a, v))))::BIGINT AS fn FROM x),
    f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
    SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM f
""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("quality") == 0, F.array(F.lit("symbols"), F.lit("shouting"))).otherwise(F.array().cast("array<string>"))
    found = measures.missing_fields(records(spark, sf_dir), expected, F.col("flags.rule"))
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(PREDICTED_SQL + """
    SELECT lang, source, count(*) FILTER (WHERE quality = 0) AS positives, count(*) FILTER (WHERE quality = 0 AND predicted = 0) AS found, count(*) FILTER (WHERE quality <> 0) AS controls,
           count(*) FILTER (WHERE quality <> 0 AND predicted = 0) AS false_fires, round(coalesce(count(*) FILTER (WHERE quality = 0 AND predicted = 0) / nullif(count(*) FILTER (WHERE quality = 0), 0), 0), 6) AS recall
    FROM p GROUP BY ROLLUP (lang, source)
""")
def recall_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.recall_split(predicted(spark, sf_dir), F.col("quality") == 0, F.col("predicted") == 0, "lang", "source")
    return found.withColumn("recall", F.round("recall", 6))


@query(PREDICTED_SQL + """
    SELECT CASE WHEN grouping(half) = 1 THEN 'all' ELSE half END AS split, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS kind, count(*) FILTER (WHERE quality = predicted) AS hits, count(*) AS n,
           round(count(*) FILTER (WHERE quality = predicted) / count(*), 6) AS accuracy
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'tune' ELSE 'test' END AS half FROM p) GROUP BY CUBE (half, lang)
""")
def split_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a prediction is right, by split, by kind, by both and over all."""
    rows = predicted(spark, sf_dir).withColumn("half", F.when(F.col("doc_id") % 2 == 0, "tune").otherwise("test"))
    found = measures.accuracy_split(rows, F.col("quality") == F.col("predicted"), "half", "lang")
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query(PREDICTED_SQL + " SELECT source AS category, count(*) AS n, round(avg(CASE WHEN quality = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY source")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.count_if(F.col("quality") == F.col("predicted"))
    return predicted(spark, sf_dir).groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"), F.round(ratio(right, F.count("*")), 6).alias("accuracy"))


@query(f"""
    WITH RECURSIVE {RECORDS_SQL}, d AS (SELECT toxic <> 1 AND len(list_filter(rules, lambda x: x <> 'not_english')) = 0 AS approved, quality = 1 AS correct FROM records),
    s AS (SELECT count(*) AS records, count(*) FILTER (WHERE approved) AS approved, count(*) FILTER (WHERE approved AND correct) AS correct_approved FROM d),
    b AS (SELECT 0 AS step, approved AS n, correct_approved AS k, 0.0::DOUBLE AS low, (correct_approved / approved)::DOUBLE AS high FROM s UNION ALL
          SELECT step + 1, n, k, CASE WHEN above THEN low ELSE mid END, CASE WHEN above THEN mid ELSE high END FROM (SELECT *, (low + high) / 2 AS mid,
          list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((low + high) / 2) + (n - i) * ln(1 - (low + high) / 2)))) > 0.05 AS above FROM b WHERE step < 50))
    SELECT records, approved, correct_approved, round(approved / records, 6) AS coverage, round(correct_approved / approved, 6) AS precision, round(CASE WHEN k = n THEN pow(0.05, 1 / n) ELSE low END, 6) AS lower_bound FROM s, b WHERE step = 50
""")
def precision_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's precision with the lower bound of its confidence interval."""
    found = measures.gate_measure(records(spark, sf_dir).withColumn("d", decision()), F.col("d"), F.col("quality") == 1)
    bound = measures.lower_bound(F.col("correct_approved"), F.col("approved"))
    return found.withColumn("lower_bound", bound).withColumns({c: F.round(c, 6) for c in ("coverage", "precision", "lower_bound")})


@query(CLASS_SQL + """,
    m AS (SELECT 'macro_f1' AS metric, round(avg(f1), 6) AS value, 0.85 AS target, 'gte' AS direction FROM g
          UNION ALL SELECT 'unlabelled_share', round((SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) / (SELECT count(*) FROM documents), 6), 0.07, 'lte'
          UNION ALL SELECT 'unmeasured', NULL, 0.5, 'gte')
    SELECT metric, value, CASE WHEN value IS NULL THEN 'unmeasured' WHEN (direction = 'gte' AND value >= target) OR (direction = 'lte' AND value <= target) THEN 'pass' ELSE 'fail' END AS status FROM m
""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows against their targets."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    f1 = macro_f1(spark, sf_dir).select(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value"), F.lit(0.85).alias("target"), F.lit("gte").alias("direction"))
    unlabelled = documents.join(labels.select("doc_id").distinct().withColumn("known", F.lit(1)), "doc_id", "left")
    share = unlabelled.agg(F.round(ratio(F.count_if(F.col("known").isNull()), F.count("*")), 6).alias("value"))
    rows = f1.unionByName(share.select(F.lit("unlabelled_share").alias("metric"), "value", F.lit(0.07).alias("target"), F.lit("lte").alias("direction")))
    rows = rows.unionByName(share.select(F.lit("unmeasured").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(0.5).alias("target"), F.lit("gte").alias("direction")))
    return rows.select("metric", "value", measures.metric_status(F.col("value"), F.col("target"), F.col("direction")).alias("status"))


@query("SELECT item_id, sha256(text) AS fingerprint, sha256(text) IN (SELECT sha256(text) FROM documents) AS known FROM benchmark")
def stale_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the pinned items, and whether the corpus still holds them as they were."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    corpus = table(spark, sf_dir, "documents").select(digest("text").alias("fingerprint")).distinct().withColumn("known", F.lit(True))
    items = table(spark, sf_dir, "benchmark").select("item_id", digest("text").alias("fingerprint"))
    return items.join(corpus, "fingerprint", "left").select("item_id", "fingerprint", F.coalesce("known", F.lit(False)).alias("known"))
