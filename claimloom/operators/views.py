"""The flat relational view over claims whose extraction is a JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import iso_date, three_valued

#: The view's columns in the order of its contract.
FLAT_COLUMNS = (
    "id channel content_type urgency status message_status received_at created_at updated_at policy_no plate incident_date city district "
    "damage_description damage_type injury counterparty_exists estimated_amount"
).split()


def json_text(document: Column, *path: str) -> Column:
    """The text at a path of a JSON document, null where there is none."""
    return F.get_json_object(document, "$." + ".".join(path))


def json_decimal(document: Column, *path: str) -> Column:
    """A number at a path as decimal(38,10), null where it is none."""
    return json_text(document, *path).try_cast("decimal(38,10)")


def claims_flat(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """claims (data: JSON text) with their messages, flat and typed; a value that does not fit its type is null, and
    booleans are true, false or null for not mentioned. Messages are joined by raw_message_id."""
    at = lambda *path: json_text(F.col("c.data"), "extraction", *path)
    joined = claims.alias("c").join(messages.alias("m"), F.col("c.raw_message_id") == F.col("m.id"))
    return joined.select(
        "c.id", "c.channel", "c.content_type", "c.urgency", "c.status", F.col("m.status").alias("message_status"), "m.received_at", "c.created_at", "c.updated_at",
        at("policy_no").alias("policy_no"), at("plate").alias("plate"), iso_date(at("incident_date")).alias("incident_date"),
        at("incident_location", "city").alias("city"), at("incident_location", "district").alias("district"),
        at("damage_description").alias("damage_description"), at("damage_type").alias("damage_type"),
        three_valued(at("injury")).alias("injury"), three_valued(at("counterparty_exists")).alias("counterparty_exists"),
        json_decimal(F.col("c.data"), "extraction", "estimated_amount").alias("estimated_amount"),
    )


def retrieved(flat: DataFrame, embeddings: DataFrame, urgency: str | None = None, status: str | None = None) -> DataFrame:
    """Claims with their vectors (claim_id, embedding), filtered before any ranking."""
    if urgency is not None:
        flat = flat.where(F.col("urgency") == urgency)
    if status is not None:
        flat = flat.where(F.col("status") == status)
    return flat.join(embeddings, flat["id"] == embeddings["claim_id"])
