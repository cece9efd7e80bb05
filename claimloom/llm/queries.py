"""The registered queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontamination, divergence, html_text, language_id, line_dedup, mixing, paragraphs, prefix_forest, quality, simhash, spelling, url_filter, warc
from claimloom.llm.runtime import checkpoint_dir, fold_bucket, modest_batches
from claimloom.llm.runtime import table as read_table

SOURCE_WEIGHTS, MIX_EPOCHS = (5, 2, 1), 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return read_table(spark, sf_dir, name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are not held out and teach nothing, for no label can name them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10, min_docs=2)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.resolved_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are not held out and teach nothing."""
    docs = table(spark, sf_dir, "documents")
    bucket = fold_bucket(F.col("doc_id"), 4)
    held_out = F.coalesce(bucket == 2, F.lit(False))
    model = language_id.train(docs.where(bucket != 2))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.language(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, sources, _ = mixing.mix(docs, "doc_id", mixing.word_count(F.col("text")), F.array("source"), SOURCE_WEIGHTS, MIX_EPOCHS)
    sizes, targets = [x[0] for x in sources.values()], [x[1] for x in sources.values()]
    known = spark.createDataFrame(pa.table({"name": pa.array(sources, pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(targets, pa.float64())}))
    joined = rows.join(known, F.col("sources")[0].eqNullSafe(F.col("name")), "left")
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_simhash_near_dedup,
        op3_decontamination,
        op4_html_extraction,
        op5_substring_dedup,
        op6_line_dedup,
        op7_nearest_neighbours,
        op8_warc_revisits,
        op9_language_id,
        op10_source_mixing,
        op11_spelling_variants,
        op12_url_filter,
        op13_source_divergence,
    )
}
