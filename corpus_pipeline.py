"""A training corpus from raw documents: five stages, each on all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontamination, language_id, line_dedup, mixing, simhash
from claimloom.llm.queries import MIX_EPOCHS, SOURCE_WEIGHTS
from claimloom.llm.runtime import checkpoint_dir, fold_bucket, fresh, lean_workers, modest_batches, table

#: A document goes if the language that most of its letters have is less probable than this.
MIN_LANGUAGE_SCORE = 0.3


def lean(spark: SparkSession) -> None:
    modest_batches(spark)
    lean_workers(spark)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: those without a letter or a probable language go, null and blank texts too.

    Rows stay as they are; repeated rows stay or go together, a table without a language keeps none, and other columns are
    not looked at."""
    lean(spark)
    model = language_id.train(docs.where(fold_bucket(F.col("doc_id"), 4) != 2))
    (name,) = fresh(docs, "found")
    found = docs.withColumn(name, language_id.language(F.col("text"), model))
    return found.where((F.col(f"{name}.lang") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds; a document left without text stays, with an empty one, as does a null text.

    Repeated rows stay; rows without an id keep their lines."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of equal or similar documents, by five-word shingles.

    Null and blank texts are one group; repeated rows leave one; rows without an id stay."""
    lean(spark)
    return simhash.keep_one(docs, n=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item; null texts hold none, and without items all rows stay, repeated ones too."""
    lean(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix repeats each document and how many of its words it takes; documents not taken go.

    Documents without words are never taken; repeated rows are documents of their own; a null source is one; an empty
    table gives no rows."""
    rows, _, _ = mixing.mix(docs, "doc_id", mixing.word_count(F.col("text")), F.array("source"), SOURCE_WEIGHTS, MIX_EPOCHS)
    taken = rows.where("taken > 0").select("doc_id", F.element_at("sources", 1).alias("source"), "size", "taken")
    return taken.withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the language model nor the fingerprints; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written to the shared folder as Parquet and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
