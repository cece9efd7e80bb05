"""Files written and read again, and the steps of the triage over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import masking, text
from claimloom.operators.answers import plain_quotes
from claimloom.operators.measures import equal_when_normal
from claimloom.operators.rules import sanity_flags
from claimloom.plans.registry import query, table
from claimloom.sources import files
from claimloom.sources.generator import relative_day
from claimloom.sources.shared import modest_batches, scratch
from claimloom.streaming import triage


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines, read again strictly."""
    path = scratch(spark, "lines")
    files.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("""
    SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS status, count(*) AS n FROM orders WHERE o_orderkey % 89 <> 0 GROUP BY 1
""")
def lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which some are blank and some malformed, read leniently: blank ones are no rows, malformed ones rows of nulls."""
    path, key = scratch(spark, "lenient"), F.col("o_orderkey")
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    orders = table(spark, sf_dir, "orders").select(F.when(key % 89 == 0, "  ").when(key % 97 == 0, F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(line).alias("value"))
    orders.write.text(path)
    rows = files.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string", strict=False)
    return rows.groupBy(F.when(rows["o_orderkey"].isNotNull(), rows["o_orderstatus"]).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, 'orders' AS origin FROM orders GROUP BY ALL")
def kept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with its records and where they come from, kept and read again."""
    path = scratch(spark, "run")
    files.write_run(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, {"origin": "orders"})
    rows, meta = files.read_run(spark, path)
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("origin", F.lit(meta["origin"]))


@query("SELECT DISTINCT event_type AS entry FROM events UNION SELECT DISTINCT user_id::VARCHAR FROM events")
def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file with blanks around its entries, empty lines and repeats."""
    path, events = scratch(spark, "words"), table(spark, sf_dir, "events")
    entries = F.explode(F.array(F.concat(F.lit("  "), F.col("event_type")), F.lit(""), F.concat(F.col("user_id").cast("string"), F.lit(" ")), F.lit("   ")))
    events.select(entries.alias("value")).write.text(path)
    return files.read_dictionary(spark, path)


@query("SELECT event_type || ' ' || event_id AS text, CASE WHEN event_id % 10 <> 3 THEN event_id END::INT AS \"offset\" FROM events WHERE event_id % 10 <> 7")
def delimited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text and a number; those without a separator are left out, and what is no number is null."""
    path, key = scratch(spark, "pairs"), F.col("event_id")
    name = F.concat_ws(" ", "event_type", "event_id")
    number = F.when(key % 10 == 3, "many").otherwise(F.concat(F.lit(" "), key.cast("string")))
    table(spark, sf_dir, "events").select(F.when(key % 10 == 7, name).otherwise(F.concat(name, F.lit("|"), number)).alias("value")).write.text(path)
    return files.read_pairs(spark, path)


@query("""
    WITH seeded AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 500)
    SELECT o_orderkey FROM seeded WHERE o_orderstatus <> 'F'
""")
def unfinished_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first orders, put where a stream reads them, those without a final status."""
    orders, folder = table(spark, sf_dir, "orders"), scratch(spark, "seeds")
    files.load_first(orders.select("o_orderkey"), "o_orderkey", 500, folder, files=4)
    seeded = spark.read.parquet(folder)
    return files.unfinished(seeded, orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey", ("F",))


@query("""
    WITH c AS (SELECT c_custkey, abs(c_acctbal) AS v, c_custkey % 4 AS way FROM customer)
    SELECT c_custkey, CASE way WHEN 0 THEN round(v, 2) WHEN 1 THEN round(v, 2) WHEN 2 THEN floor(v) ELSE floor(v) * 1000 + 5 END::DOUBLE AS number FROM c
""")
def float_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with points between thousands, with a decimal comma, with points at the end, and as digits alone, read as floats."""
    v, way = F.abs("c_acctbal"), F.col("c_custkey") % 4
    whole = F.floor(v).cast("string")
    grouped = F.translate(F.format_number(v, 2), ",.", ".,")
    comma = F.replace(F.round(v, 2).cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))
    written = F.when(way == 0, grouped).when(way == 1, comma).when(way == 2, F.concat(whole, F.lit(".,"))).otherwise(F.concat(whole, F.lit("005")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.number_as_float(written).alias("number"))


@query("""
    SELECT o_orderkey % 4 AS way, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 < 2) AS plates, count(*) FILTER (WHERE o_orderkey % 4 <> 3) AS texts, count(*) FILTER (WHERE o_orderstatus <> 'F' OR o_orderkey % 4 = 0) AS injuries
    FROM orders GROUP BY 1
""")
def compared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found values in several spellings, compared as their fields demand; an injury that is not known is none."""
    key = F.col("o_orderkey")
    way, number = key % 4, F.lpad((key % 1000).cast("string"), 3, "0")
    plate, found = F.concat(F.lit("34ABC"), number), F.when(way == 0, F.concat(F.lit("34 abc "), number)).when(way == 1, F.concat(F.lit("34ABC"), number)).when(way == 2, F.concat(F.lit("34ABD"), number))
    said = F.when(way == 3, "cam").otherwise(F.concat(F.lit(" "), F.initcap("o_orderpriority"), F.lit(" ")))
    injured = F.when(F.col("o_orderstatus") == "F", True)
    rows = table(spark, sf_dir, "orders").select(
        way.alias("way"), equal_when_normal("plate", plate, found).alias("plate"), equal_when_normal("damage_type", F.lower("o_orderpriority"), said).alias("text"),
        equal_when_normal("injury", injured, F.when(way == 0, injured)).alias("injury"),
    )
    return rows.groupBy("way").agg(F.count("*").alias("n"), F.count_if("plate").alias("plates"), F.count_if("text").alias("texts"), F.count_if("injury").alias("injuries"))


@query(r"""
    WITH q AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' 0532 111 22 33' ELSE '' END AS question FROM conversations)
    SELECT conv_id, turn, regexp_matches(question, '\b[1-9][0-9]{10}\b|\b0?5\d{2}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}\b|\b\d{2}\s?[A-ZÇĞİÖŞÜ]{1,3}\s?\d{1,4}\b|\bTR\d{24}\b') AS masked, false AS held FROM q
""")
def masked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions, some with a phone number: whether a placeholder of questions stands in them, and whether the number still does."""
    question = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, " 0532 111 22 33").otherwise(""))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", masking.mask_question(question).alias("q"))
    return found.select("conv_id", "turn", masking.has_question_placeholder(F.col("q.text")).alias("masked"), F.contains("q.text", F.lit("0532 111 22 33")).alias("held"))


SAID = ("deniz bugun dalgali", "Sayın Deniz geldi", "Deniz Yılmaz aradı", "imza Ahmet")


@query("""
    SELECT doc_id, ['deniz bugun dalgali', 'Sayın [NAME_1] geldi', '[NAME_1] Yılmaz aradı', 'imza [NAME_1]'][1 + doc_id % 4] AS tail, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS names FROM documents
""")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at the end of documents: one that is a common word counts beside a surname or after a marker only."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % 4 + 1).cast("int"))
    ends = F.element_at(F.array(*[F.lit(len(x.split())) for x in SAID]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = files.spread(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", F.lit("| . | . | . | ."), said).alias("text")))
    names = spark.createDataFrame([("Deniz",), ("Ahmet",)], "name string")
    found = masking.mask_all(docs, "doc_id", "text", names).withColumn("words", F.split("masked_text", " "))
    named = F.filter("mappings", lambda m: m["pii_type"] == "NAME")
    return found.select("doc_id", F.array_join(F.slice("words", F.size("words") - ends + 1, ends), " ").alias("tail"), F.size(named).alias("names"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 AND doc_id % 50 + 10 <= length(coalesce(text, '')) THEN 'name' WHEN doc_id % 3 = 1 THEN 'name' ELSE 'other' END AS kind,
           CASE WHEN doc_id % 3 = 1 AND doc_id % 50 + 10 <= length(coalesce(text, '')) THEN (doc_id % 50)::INT END AS start
    FROM documents
""")
def sanity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of verdicts on documents: none, a name with its place where that is inside the text, and another where there is no verdict."""
    begin = (F.col("doc_id") % 50).cast("int")
    flag = F.struct(F.lit("name").alias("kind"), begin.alias("start"), (begin + 10).alias("end"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    verdict = F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit(False).alias("leak_found"), none.alias("flags"))).when(F.col("doc_id") % 3 == 1, F.struct(F.lit(True).alias("leak_found"), F.array(flag).alias("flags")))
    rows = table(spark, sf_dir, "documents").select("doc_id", sanity_flags(verdict, F.coalesce("text", F.lit(""))).alias("flags"))
    first = F.get("flags", F.lit(0))
    return rows.select("doc_id", F.coalesce(first["kind"], F.lit("none")).alias("kind"), first["span"]["start"].alias("start"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE d WHEN 0 THEN 'bugün' WHEN 1 THEN 'dün' WHEN 2 THEN 'önceki gün' ELSE d || ' gün önce' END AS phrase
    FROM (SELECT l_orderkey, l_linenumber, abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
""")
def relative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far items were shipped from their order, in words."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", relative_day(F.abs(F.date_diff("l_shipdate", "o_orderdate"))).alias("phrase"))


@query("""
    SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS quote FROM events
""")
def unwrapped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as texts, or in objects of several forms; an object without one gives none."""
    way, kind = F.col("event_id") % 5, F.col("event_type")
    form = F.when(way < 3, F.concat(F.lit('{"'), F.element_at(F.array(F.lit("quote"), F.lit("text"), F.lit("value")), F.least(way, F.lit(2)).cast("int") + 1), F.lit('": "'), kind, F.lit('"}')))
    quotes = plain_quotes(F.create_map(F.lit("field"), form.when(way == 3, kind).otherwise('{"other": 1}')))
    return table(spark, sf_dir, "events").select("event_id", F.size(quotes).alias("n"), F.try_element_at(quotes, F.lit("field")).alias("quote"))


@query("""
    SELECT doc_id AS id, CASE WHEN coalesce(trim(text), '') = '' THEN 'dead_letter' ELSE 'in_human_review' END AS status, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty message' END AS error,
           CASE WHEN source = 'src0' THEN 'claim' ELSE 'info_request' END AS content_type, source IS NOT DISTINCT FROM 'src0' AS extracted,
           CASE WHEN source = 'src0' THEN 6 ELSE 4 END - CASE WHEN source = 'src0' THEN 1 ELSE 1 END AS steps
    FROM documents
""")
def triaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: those of one source are claims, only claims are extracted, those without text go to the dead letter, and the audit has a row a step.

    Each document is triaged once: its steps are counted where it is, and not joined to it."""
    modest_batches(spark)
    docs = files.spread(table(spark, sf_dir, "documents"))
    messages = docs.select(F.col("doc_id").alias("id"), F.lit("email").alias("channel"), F.col("text").alias("raw_text"), F.col("source").alias("external_ref"), F.lit("2026-01-01").cast("timestamp").alias("received_at"))
    recorded = lambda rows: spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "external_ref string, payload string")
    answers = triage.Answers(
        recorded([("src0", {"content_type": "claim", "urgency": "high"}), ("*", {"content_type": "info_request", "urgency": "normal"})]),
        recorded([("*", {"damage_type": "collision", "policy_no": "POL-2026-00001", "quotes": {}})]),
    )
    done = triage.triage(messages, answers, spark.createDataFrame([("ahmet",)], "name string"))
    return done.select("id", "status", "error", "content_type", F.col("extraction").isNotNull().alias("extracted"), F.size(triage.audit_steps()).alias("steps"))
