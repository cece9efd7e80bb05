"""The triage of messages as one DataFrame job, run in batches or on a stream with a dead letter for what fails."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimloom.functions.isolated import Function, isolated
from claimloom.functions.masking import unmask_struct, with_all_masks
from claimloom.functions.signals import signals
from claimloom.functions.text import locate_quote
from claimloom.operators.joins import latest
from claimloom.operators.retrieval import PASSAGE, Encoder, unit_vectors
from claimloom.operators.rules import approval, classify, filled_names, sanity_flags, validation_flags
from claimloom.streaming.keyed import KeyedTable

MESSAGE = "id long, channel string, raw_text string, external_ref string, received_at timestamp"
CLASSIFICATION = "struct<content_type:string,urgency:string,injury_mentioned:boolean>"
SANITY_FLAGS = "array<struct<rule:string,kind:string,span:struct<start:int,end:int>>>"
SANITY = "struct<leak_found:boolean,flags:array<struct<kind:string,start:int,end:int>>>"
EXTRACTION = (
    "struct<policy_no:string,plate:string,incident_date:string,incident_location:struct<city:string,district:string>,damage_description:string,"
    "damage_type:string,injury:boolean,counterparty_exists:boolean,estimated_amount:double,quotes:map<string,string>>"
)


Model = Callable[[], Function]
Source = DataFrame | Model


@dataclass(frozen=True)
class Answers:
    """What models say: tables of recorded answers (external_ref, payload JSON), in which * is the answer for all other messages, or makers of
    functions from masked texts to payloads, which may fail on some."""

    classification: Source
    extraction: Source
    sanity: Source | None = None  # verdicts on masked texts; without them the check is not run
    masking: Model | None = None  # masks further what patterns and names have left, and gives the text


def answered(df: DataFrame, answers: Source, kind: str, name: str, step: str) -> DataFrame:
    """df with the answer to its masked text, parsed; null if there is none. What a function fails on is in _failed_<step>."""
    failed = f"_failed_{step}"
    if not isinstance(answers, DataFrame):
        said = df.withColumn("_said", isolated(F.col("masked_text"), answers, "string"))
        return said.withColumn(name, F.from_json("_said.value", kind)).withColumn(failed, F.col("_said.error")).drop("_said")
    own = answers.where("external_ref != '*'").select("external_ref", F.col("payload").alias("_own"))
    other = answers.where("external_ref = '*'").agg(F.max("payload").alias("_any"))
    joined = df.join(own, "external_ref", "left").join(F.broadcast(other))  # one row
    return joined.withColumn(name, F.from_json(F.coalesce("_own", "_any"), kind)).withColumn(failed, F.lit(None).cast("string")).drop("_own", "_any")


def masked_further(df: DataFrame, masking: Model | None) -> DataFrame:
    """df with masked_text as the model masks it. Where the model fails, the text stays as patterns and names have masked it, and is never the raw one."""
    if masking is None:
        return df.withColumn("_failed_masking", F.lit(None).cast("string"))
    said = df.withColumn("_said", isolated(F.col("masked_text"), masking, "string"))
    return said.withColumn("masked_text", F.coalesce("_said.value", "masked_text")).withColumn("_failed_masking", F.col("_said.error")).drop("_said")


def evidence(extraction: Column, text: Column) -> Column:
    """array<struct(field, quote, span)> for the filled fields: where their quote stands, or else their value."""
    fields = {n: extraction[n].cast("string") for n in ("policy_no", "plate", "incident_date", "damage_description", "damage_type", "injury", "counterparty_exists", "estimated_amount")}
    fields |= {f"incident_location.{n}": extraction["incident_location"][n] for n in ("city", "district")}
    rows = []
    for name, value in fields.items():
        quote = F.coalesce(F.try_element_at(extraction["quotes"], F.lit(name)), value)
        rows.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("field"), quote.alias("quote"), locate_quote(quote, text).alias("span"))))
    return F.array_compact(F.array(*rows))


def triage(messages: DataFrame, answers: Answers, names: DataFrame, auto_approve: bool = False, as_of: Column | None = None) -> DataFrame:
    """One row a message: masked text, mappings, signals, classification, extraction with evidence, flags, decision,
    status, failures (the steps whose function failed on it, with the kind of error) and, for a message without text, error.

    Steps fail on their own: without a classification the rules stand in, without an extraction a claim goes to
    review, a sanity check without a verdict counts as a leak; flags of the check never hold text. A message that is no
    claim is not extracted. Messages without text, and those on which the rules themselves fail, have status dead_letter.
    """
    masked = masked_further(with_all_masks(messages, "id", "raw_text", names), answers.masking)
    read = answered(masked, answers.classification, CLASSIFICATION, "model", "classification")
    read = answered(read, answers.extraction, EXTRACTION, "found", "extraction").withColumn("_failed_masking_sanity", F.lit(None).cast("string"))
    leak, sanity = F.lit(False), F.array().cast(SANITY_FLAGS)
    if answers.sanity is not None:
        read = answered(read.drop("_failed_masking_sanity"), answers.sanity, SANITY, "verdict", "masking_sanity")
        leak, sanity = F.coalesce(F.col("verdict.leak_found"), F.lit(True)), sanity_flags(F.col("verdict"), F.col("masked_text"))
    read = read.withColumns({"leak": leak, "sanity": sanity, "terms": signals(F.col("masked_text"))})
    read = read.withColumn("signals", F.coalesce("terms", F.array().cast("array<string>")))
    read = read.withColumn("class", classify(F.col("model.content_type"), F.col("model.urgency"), F.col("model.injury_mentioned"), F.col("signals")))
    is_claim = F.col("class.content_type") == "claim"
    read = read.withColumn("found", F.when(is_claim, F.col("found"))).withColumn("evidence", F.when(F.col("found").isNotNull(), evidence(F.col("found"), F.col("masked_text"))))
    unverified = F.coalesce(F.transform(F.filter("evidence", lambda e: e["span"].isNull()), lambda e: e["field"]), F.array().cast("array<string>"))
    read = read.withColumn("unverified", unverified).withColumn("extraction", unmask_struct(read, "found", F.col("mappings")))
    flags = validation_flags(F.col("extraction"), F.col("class.urgency"), F.col("class.content_type"), F.col("signals"), as_of)
    read = read.withColumn("flags", F.when(F.col("extraction").isNotNull(), flags).otherwise(F.array().cast("array<struct<field:string,rule:string,message:string>>")))
    decision = approval(F.col("class.content_type"), F.col("class.urgency"), F.col("flags"), F.col("unverified"), F.col("leak"), F.col("extraction").isNotNull(), auto_approve)
    error = F.when(F.coalesce(F.trim("raw_text"), F.lit("")) == "", "empty message").when(F.col("terms").isNull(), "signals failed")
    read = read.withColumn("decision", decision).withColumn("error", error)
    failures = [F.when(F.col(f"_failed_{step}").isNotNull(), F.struct(F.lit(step).alias("step"), F.col(f"_failed_{step}").alias("kind"))) for step in ("masking", "classification", "extraction", "masking_sanity")]
    failures.append(F.when(F.col("terms").isNull(), F.struct(F.lit("signals").alias("step"), F.lit("Exception").alias("kind"))))
    read = read.withColumn("failures", F.array_compact(F.array(*failures)))
    status = F.when(F.col("error").isNotNull(), "dead_letter").when(F.col("decision.approved"), "approved").otherwise("in_human_review")
    return read.select("id", "channel", "received_at", "masked_text", "mappings", "signals", "class.*", "extraction", "evidence", "unverified", "flags", "sanity", "decision", status.alias("status"), "error", "failures")


def filled_fields(extraction: Column) -> Column:
    names = ("policy_no", "plate", "incident_date", "damage_description", "damage_type", "injury", "counterparty_exists", "estimated_amount")
    return filled_names({n: extraction[n] for n in names} | {f"incident_location.{n}": extraction["incident_location"][n] for n in ("city", "district")})


def audit_steps() -> Column:
    """The steps that a triaged message went through, as array<struct(step, detail as JSON)>."""
    steps = [
        ("masking", F.to_json(F.struct(F.size("mappings").alias("masked"))), F.lit(True)),
        ("masking_sanity", F.to_json(F.struct("sanity")), F.size("sanity") > 0),
        ("classification", F.to_json(F.struct("content_type", "urgency", "urgency_source", "signals")), F.lit(True)),
        ("extraction", F.to_json(F.struct("unverified")), F.col("extraction").isNotNull()),
        ("validation", F.to_json(F.struct("flags")), F.col("extraction").isNotNull()),
        ("auto_approve", F.to_json(F.struct("decision")), F.col("error").isNull()),
        ("pipeline_error", F.to_json(F.struct("error")), F.col("error").isNotNull()),
    ]
    rows = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(s).alias("step"), d.alias("detail"))) for s, d, when in steps]))
    failed = F.transform("failures", lambda f: F.struct(F.concat(f["step"], F.lit("_error")).alias("step"), F.to_json(F.struct(f["kind"].alias("kind"))).alias("detail")))
    return F.concat(rows, failed)


def audit_rows(triaged: DataFrame, at: Column) -> DataFrame:
    """One row a step that a message went through: raw_message_id, step, detail (JSON), created_at."""
    return triaged.select(F.col("id").alias("raw_message_id"), F.inline(audit_steps()), at.alias("created_at"))


def with_vectors(triaged: DataFrame, encoder: Callable[[], Encoder] | None, dim: int) -> DataFrame:
    """triaged with the vectors of the masked texts of claims; those on which the encoder fails have none, and it counts among their failures."""
    if encoder is None:
        return triaged.withColumn("embedding", F.lit(None).cast("array<float>"))
    wanted = F.when(F.col("error").isNull() & (F.col("content_type") == "claim"), F.col("masked_text"))
    tried = triaged.withColumn("_tried", isolated(wanted, lambda: unit_vectors(encoder(), PASSAGE, dim), "array<float>"))
    failed = F.when(F.col("_tried.error").isNotNull(), F.array(F.struct(F.lit("embedding").alias("step"), F.col("_tried.error").alias("kind"))))
    return tried.withColumn("embedding", F.col("_tried.value")).withColumn("failures", F.concat("failures", F.coalesce(failed, F.array().cast("array<struct<step:string,kind:string>>")))).drop("_tried")


@functools.cache
def result_schema(spark: SparkSession) -> StructType:
    no_names, no_answers = spark.createDataFrame([], "name string"), spark.createDataFrame([], "external_ref string, payload string")
    return with_vectors(triage(spark.createDataFrame([], MESSAGE), Answers(no_answers, no_answers), no_names), None, 0).schema


def results(spark: SparkSession, target: str) -> KeyedTable:
    """The table of what became of each message, the last one of an id in order of received_at."""
    return KeyedTable(spark, f"{target}/messages", result_schema(spark), "id", ("received_at",))


def output(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One of claims, mappings, dead_letter and vectors, a row or group of rows for each message, or the audit."""
    if name == "audit":
        return spark.read.parquet(f"{target}/audit")
    found = results(spark, target).read()
    return {
        "claims": found.where("error is null").drop("mappings", "embedding"),
        "mappings": found.select(F.col("id").alias("raw_message_id"), F.inline("mappings")),
        "dead_letter": found.where("error is not null").select("id", "channel", "received_at", "error"),
        "vectors": found.where("embedding is not null").select(F.col("id").alias("claim_id"), "embedding"),
    }[name]


def start(spark: SparkSession, source: str, target: str, answers: Answers, names: DataFrame, checkpoint: str, encoder: Callable[[], Encoder] | None = None, dim: int = 384, **trigger) -> StreamingQuery:
    """Triage the messages that arrive as JSON files in `source` into `target`; output() reads it.

    A message that comes again, in the same batch or a later one, replaces what was known of its id, so that it has one claim, one vector and one set of
    mappings; the audit keeps every time. A batch that is run again changes nothing. Messages without an id are not taken."""
    arriving = spark.readStream.schema(MESSAGE).json(source)
    kept = results(spark, target)

    def batch(messages: DataFrame, number: int) -> None:
        newest = latest(messages.where("id is not null"), "id", "received_at")
        done = with_vectors(triage(newest, answers, names), encoder, dim).persist()
        kept.merge(done, number)
        audit_rows(done, F.current_timestamp()).write.mode("overwrite").parquet(f"{target}/audit/batch={number}")
        done.unpersist()

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
