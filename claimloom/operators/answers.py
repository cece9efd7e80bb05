"""Answers to questions: routes, sources, withholding, and how they are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import contains_any, numbers_in, split_citations, unverified_numbers

MISSING = "belirtilmemiş"


def route_mode(by_sql: Column, by_retrieval: Column) -> Column:
    """sql, retrieval or, for both, hybrid; without a decision retrieval."""
    return F.when(by_sql & by_retrieval, "hybrid").when(by_sql, "sql").otherwise("retrieval")


def sources_block(sources: DataFrame, question: str, order: str) -> DataFrame:
    """One text a question: its sources numbered from 1 with urgency, date and snippet."""
    number = F.row_number().over(Window.partitionBy(question).orderBy(order))
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] (aciliyet: "), F.coalesce("urgency", F.lit(MISSING)), F.lit(", olay tarihi: "), F.coalesce(F.col("incident_date").cast("string"), F.lit(MISSING)), F.lit(")\n"), F.col("snippet"))
    rows = sources.select(question, number.alias("n"), head.alias("line")).groupBy(question).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return rows.select(question, F.array_join("x.line", "\n\n").alias("sources"))


def retrieval_refusal(answerable: Column, source_count: Column, cited: Column) -> Column:
    """Why a retrieved answer is withheld: no sources, the model's own refusal, or no citation of a real source."""
    valid = split_citations(cited, F.sequence(F.lit(1), F.greatest(source_count, F.lit(1))))["valid"]
    return F.when(source_count == 0, "no_sources").when(~F.coalesce(answerable, F.lit(False)), "not_answerable").when(F.size(valid) == 0, "no_valid_citation")


def sql_refusal(answerable: Column, answer: Column, rendered: Column, row_count: Column) -> Column:
    """Why an answer over rows is withheld: an empty result, the model's own refusal, or a number not in the rows."""
    return (
        F.when(row_count == 0, "empty_result").when(~F.coalesce(answerable, F.lit(False)) | answer.isNull(), "not_answerable")
        .when(F.size(unverified_numbers(answer, rendered, row_count)) > 0, "unverified_number")
    )


def sql_answer_right(answerable: Column, answer: Column, expected: Column, expected_any: Column) -> Column:
    """Whether the answer has the reference value, as a number rounded half to even or as a folded word, or one of
    the words that count as well."""
    value = expected.try_cast("double")
    as_number = F.exists(numbers_in(answer), lambda n: F.bround(n, 0) == F.bround(value, 0))
    as_word = contains_any(answer, F.array(expected))
    widened = F.coalesce(contains_any(answer, expected_any), F.lit(False))
    known = expected.isNotNull() & (expected != "")
    right = widened | (known & F.when(value.isNotNull(), as_number).otherwise(as_word))
    return F.coalesce(answerable & answer.isNotNull() & right, F.lit(False))


def retrieval_answer_right(answerable: Column, cited_ids: Column, expected_ids: Column) -> Column:
    return F.coalesce(answerable & F.arrays_overlap(cited_ids, expected_ids), F.lit(False))


def refusal_right(answerable: Column) -> Column:
    return ~F.coalesce(answerable, F.lit(False))


def low_confidence(named: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """Fields named as unsure together with those whose confidence is under the threshold, sorted; unknown
    confidences do not count."""
    under = F.map_keys(F.map_filter(confidence, lambda k, v: v.isNotNull() & (v < threshold)))
    return F.array_sort(F.array_union(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(under, F.array().cast("array<string>"))))


def plain_quotes(quotes: Column) -> Column:
    """Quotes as text from a map to JSON values: a text, or an object with quote, text or value."""
    read = lambda v: F.coalesce(*[F.get_json_object(v, f"$.{n}") for n in ("quote", "text", "value")], F.when(~F.ltrim(v).startswith("{"), v))
    return F.map_filter(F.transform_values(quotes, lambda k, v: read(v)), lambda k, v: v.isNotNull())


def relative_date(phrase: Column, at: Column, known: DataFrame, df: DataFrame) -> DataFrame:
    """df with a date for a phrase of the dictionary (text, offset in days), counted from `at`; the dictionary is
    joined."""
    listed = known.select(F.lower(F.trim("text")).alias("_phrase"), F.col("offset").alias("_offset"))
    joined = df.withColumn("_phrase", F.lower(F.trim(phrase))).join(listed, "_phrase", "left")
    return joined.withColumn("resolved_date", F.date_add(F.to_date(at), F.col("_offset"))).drop("_phrase", "_offset")
