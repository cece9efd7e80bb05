"""Files in and out: JSON lines, run files, dictionaries, scenarios, recorded answers, fingerprints."""

from __future__ import annotations

import functools
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.operators.joins import Unmatched


class Malformed(ValueError):
    """A file that is not what it should be."""


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with a schema, blank lines left out. strict: a malformed line raises Malformed with its file, number and beginning."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    known = F.from_json("value", StructType([*schema.fields]).add("_corrupt", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    if strict and (bad := first_line(spark, path, (F.trim("value") != "") & (known["_corrupt"].isNotNull() | known.isNull()))):
        raise Malformed("{}, line {}: {}".format(bad[0], bad[1], bad[2][:80]))
    rows = spark.read.text(path).where(F.trim("value") != "").select(known.alias("r"))
    return rows.select("r.*").drop("_corrupt")


def first_line(spark: SparkSession, path: str, wanted: Column) -> tuple[str, int, str] | None:
    """(file, number from 1, line) of the first line of the first file that `wanted`, on a column value, holds for; None if there is none.

    One pass over all files: each split, however many a file has, counts its lines and says where its first wanted line stands; the
    counts of the splits before it give the number. Nothing but a row a split is shuffled."""
    place = F.struct(F.monotonically_increasing_id().alias("row"), "value")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), place.alias("place"))
    splits = lines.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("place.row").alias("first"), F.min(F.when(wanted, F.col("place"))).alias("found"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("begin")) - F.col("n")
    found = splits.withColumn("before", before).where("found IS NOT NULL").orderBy("file", "begin").limit(1)
    row = found.select("file", (F.col("before") + F.col("found.row") - F.col("first") + 1).alias("number"), "found.value").first()
    return tuple(row) if row else None


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions than those: for long work on each row of a small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def line_number(spark: SparkSession, path: str, line: str) -> int | None:
    """The number, from 1, of the first line with that text."""
    found = first_line(spark, path, F.col("value") == line)
    return found[1] if found else None


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run(records: DataFrame, path: str, meta: dict) -> None:
    """A run: its records as Parquet and, beside them, one line of JSON on where they come from."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    records.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/records"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def write_run_json(records: DataFrame, path: str, meta: dict) -> None:
    """A run of evaluation as one JSON document {"meta": ..., "records": [...]}, which read_run_json reads. Such a document
    is one text and is written by one task: for results, not for corpora, which write_run keeps."""
    lines = records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("line"))
    body = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("body"))
    head = json.dumps({"meta": meta}, sort_keys=True, ensure_ascii=False)[:-1] + ', "records": ['
    body.select(F.concat(F.lit(head), "body", F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


@functools.lru_cache(maxsize=16)
def read_report(spark: SparkSession, path: str) -> str | None:
    """A report as JSON text, read once a session and path; None where it is missing or no JSON object."""
    try:
        row = spark.read.text(path, wholetext=True).first()
        return row[0] if row and isinstance(json.loads(row[0]), dict) else None
    except (AnalysisException, ValueError):
        return None


def load_first(messages: DataFrame, order: str, n: int, folder: str, files: int = 1) -> DataFrame:
    """The first n messages in an order, written where a stream of files reads them: the seed of a demonstration."""
    first = messages.orderBy(order).limit(n)
    first.repartition(files).write.mode("append").parquet(folder)
    return first


def unfinished(seeded: DataFrame, claims: DataFrame, key: str, final: tuple[str, ...]) -> DataFrame:
    """Seeded messages that have no claim yet or one whose status is not final: none once a stream has caught up."""
    done = claims.where(F.col("status").isin(*final)).select(key).distinct()
    return seeded.select(key).join(done, key, "left_anti")


def read_run_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict]:
    """A run as one JSON document: a bare list of records, or an object with meta and records."""
    text = spark.read.text(path, wholetext=True)
    is_list = F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")
    records = F.when(is_list, F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.from_json("value", f"struct<records:array<struct<{schema}>>>")["records"])
    meta = text.select(F.when(~is_list, F.get_json_object("value", "$.meta"))).first()
    return text.select(F.inline(records)), json.loads(meta[0]) if meta and meta[0] else {}


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a word list, one a line, stripped, none empty, each once."""
    return spark.read.text(path).select(F.trim("value").alias("entry")).where("entry != ''").distinct()


def read_pairs(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """Lines `text|number` as text and offset."""
    parts = F.split("value", f"\\Q{separator}\\E")
    return spark.read.text(path).where(F.contains("value", F.lit(separator))).select(F.trim(parts[0]).alias("text"), F.trim(parts[1]).try_cast("int").alias("offset"))


def read_scenario(text: str) -> dict:
    """A replay scenario from JSON or, where a YAML reader is installed, YAML."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise Malformed("a YAML scenario needs a YAML reader") from e
        return yaml.safe_load(text)


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers: response_model, gt_id, tier, payload (JSON text). A key that comes twice and a model without
    the default key * raise Malformed."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    found = rows.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("response_model", "gt_id", "tier", "payload")])
    twice = found.groupBy("response_model", "gt_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise Malformed(f"recorded twice: {twice[0][0]} {twice[0][1]}")
    without = found.groupBy("response_model").agg(F.bool_or(F.col("gt_id") == "*").alias("ok")).where("not ok").limit(1).collect()
    if without:
        raise Malformed(f"no answer * for {without[0][0]}")
    return found


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def require_same_corpus(pinned: dict[str, str], found: DataFrame) -> None:
    """Raise Unmatched unless every pinned digest is among those found."""
    have = {r["sha256"] for r in found.select("sha256").collect()}
    if missing := sorted(k for k, v in pinned.items() if v not in have):
        raise Unmatched(f"changed since they were pinned: {missing}")
