"""Rules, normal forms, quotes and answers, over values that the keys of orders pick from short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.operators import answers, measures, rules
from claimloom.plans import guard
from claimloom.plans.evaluation import RECORDS_SQL, decision, records
from claimloom.plans.registry import query, table


def key() -> Column:
    return F.col("o_orderkey")


def no_texts() -> Column:
    return F.array().cast("array<string>")


def pick(values: list, step: int = 1) -> Column:
    """The value that a row's key picks; neighbouring keys pick the same one in runs of `step`."""
    return F.get(F.array(*map(F.lit, values)), F.expr(f"CAST((o_orderkey div {step}) % {len(values)} AS INT)"))


def pick_sql(values: list, step: int = 1) -> str:
    shown = ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[(o_orderkey // {step}) % {len(values)} + 1]"


PLACES = ["İstanbul'da", "  ANKARA ", "Iğdır’ın", "ÇANKIRI", "", None]
PLATES = ["34 ABC 123", " 06 IK\t77", "", None, "35İZ35"]
AMOUNTS = ["12.500", "1.234,56 TL", "çok ", "980,5", "-3", "1.5", None]
QUESTIONS = [" Kaç dosya VAR? ", "ortalama TUTAR", None]


@query(rf"""
    WITH v AS (SELECT o_orderkey, {pick_sql(PLACES)} AS place, {pick_sql(PLATES)} AS plate, {pick_sql(AMOUNTS)} AS amount, {pick_sql(QUESTIONS)} AS question FROM orders),
    a AS (SELECT *, lower(replace(replace(place, 'I', 'ı'), 'İ', 'i')) AS lowered, regexp_replace(amount, '[^0-9.,-]', '', 'g') AS digits FROM v),
    b AS (SELECT *, translate(lowered, 'çğıöşü', 'cgiosu') AS folded, nullif(trim(regexp_replace(lowered, '[''’`].*$', '')), '') AS place_form,
          TRY_CAST(CASE WHEN contains(digits, ',') THEN replace(replace(digits, '.', ''), ',', '.') WHEN regexp_full_match(digits, '[0-9]{{1,3}}(\.[0-9]{{3}})+') THEN replace(digits, '.', '') ELSE digits END AS DOUBLE) AS amount_number FROM a)
    SELECT o_orderkey, lowered, folded, place_form, nullif(lower(replace(replace(regexp_replace(plate, '\s+', '', 'g'), 'I', 'ı'), 'İ', 'i')), '') AS plate_form, amount_number,
           CASE WHEN amount_number IS NULL THEN trim(amount) END AS amount_text, place_form AS city, contains(folded, 'igdir') OR contains(folded, 'cank') AS known, lower(trim(question)) AS question FROM b
""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, plates, amounts and questions as they are compared."""
    place, amount = pick(PLACES), text.normalize_amount(pick(AMOUNTS))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.lower_tr(place).alias("lowered"), text.fold_tr(place).alias("folded"), text.normalize_text(place).alias("place_form"), text.normalize_plate(pick(PLATES)).alias("plate_form"),
        amount["number"].alias("amount_number"), amount["text"].alias("amount_text"), text.normalize_location(place, pick(PLATES))["city"].alias("city"),
        text.contains_any(place, F.array(F.lit("igdir"), F.lit("Çank"))).alias("known"), text.normalize_question(pick(QUESTIONS)).alias("question"),
    )


@query(r"""
    WITH q AS (SELECT doc_id, text, trim(substring(text, 5, 30), ' ' || chr(9) || chr(10) || chr(13)) AS quote FROM documents)
    SELECT doc_id, (strpos(text, quote) - 1)::INT AS starts, (strpos(text, quote) - 1 + length(quote))::INT AS ends, sha256(quote) AS shown FROM q WHERE quote <> ''
""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes whose blanks were doubled, found again in their documents and shown from there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.btrim(F.substring("text", 5, 30), F.lit(" \t\n\r")).alias("quote")).where("quote <> ''")
    found = docs.select("doc_id", "text", text.locate_quote(F.replace("quote", F.lit(" "), F.lit("  ")), F.col("text")).alias("span"))
    return found.select("doc_id", F.col("span.start").alias("starts"), F.col("span.end").alias("ends"), F.sha2(text.highlight(F.col("text"), F.col("span.start"), F.col("span.end")).cast("binary"), 256).alias("shown"))


NUMBER = r"\d+(?:[.,]\d+)*"


def value_sql(t: str) -> str:
    return (
        f"TRY_CAST(CASE WHEN contains({t}, ',') THEN replace(replace({t}, '.', ''), ',', '.') "
        f"WHEN length({t}) - length(replace({t}, '.', '')) > 1 OR regexp_full_match({t}, '[^.]+\\.[^.]{{3}}') THEN replace({t}, '.', '') ELSE {t} END AS DECIMAL(38,10))"
    )


@query(rf"""
    WITH v AS (SELECT o_orderkey AS n, printf('%.2f', o_totalprice) AS plain, replace(replace(replace(printf('%,.2f', o_totalprice), ',', ';'), '.', ','), ';', '.') AS written FROM orders),
    a AS (SELECT n, plain, 'Toplam ' || written || ' lira, ' || (n % 9) || ' dosya [' || (n % 4) || '][' || (n % 7) || '] .' AS answer, 'total: ' || plain || ', n: ' || (n % 5) AS shown FROM v),
    t AS (SELECT *, regexp_extract_all(answer, '{NUMBER}') AS said, regexp_extract_all(shown, '{NUMBER}') AS seen, list_distinct([n % 4, n % 7]) AS once FROM a),
    k AS (SELECT *, list_append(list_transform(seen, lambda t: {value_sql('t')}), (n % 3)::DECIMAL(38,10)) AS known FROM t),
    r AS (SELECT *, regexp_replace(replace(replace(replace(answer, '[2]', '{{1}}'), '[0]', '{{2}}'), '[5]', '{{3}}'), '\[\d+\]', '', 'g') AS marked FROM k)
    SELECT n AS o_orderkey, array_to_string(list_filter(said, lambda t: NOT list_contains(seen, t) AND NOT coalesce(list_contains(known, {value_sql('t')}), false)), ' ') AS unverified,
           trim(regexp_replace(regexp_replace(translate(marked, '{{}}', '[]'), '\s+([.,;:!?])', '\1', 'g'), ' {{2,}}', ' ', 'g')) AS renumbered,
           array_to_string(list_sort(list_filter(once, lambda c: c IN (2, 0, 5))), ',') AS valid, array_to_string(list_sort(list_filter(once, lambda c: c NOT IN (2, 0, 5))), ',') AS invalid,
           '1. total: ' || plain || ', n: yok' || chr(10) || '... (1 satır daha gösterilmedi)' AS rendered FROM r
""")
def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers over rows: numbers that no row has, citations renumbered and told apart, and rows as text."""
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    written = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    rest = lambda k: (key() % k).cast("string")
    answer = F.concat(F.lit("Toplam "), written, F.lit(" lira, "), rest(9), F.lit(" dosya ["), rest(4), F.lit("]["), rest(7), F.lit("] ."))
    shown = F.concat(F.lit("total: "), plain, F.lit(", n: "), rest(5))
    valid = F.array(*map(F.lit, (2, 0, 5)))
    cited = text.split_citations(F.array((key() % 4).cast("int"), (key() % 7).cast("int"), (key() % 4).cast("int")), valid)
    rows = F.array_repeat(F.create_map(F.lit("total"), plain, F.lit("n"), F.lit(None).cast("string")), 2)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(text.unverified_numbers(answer, shown, key() % 3), " ").alias("unverified"), text.renumber_citations(answer, valid).alias("renumbered"),
        F.array_join(F.array_sort(cited["valid"]), ",").alias("valid"), F.array_join(F.array_sort(cited["invalid"]), ",").alias("invalid"), text.render_rows(rows, 1).alias("rendered"),
    )


CONTENT, URGENCY, FLAGGED, HITS = (["claim", "info_request", None, "spam"], 1), (["critical", "high", "normal", "urgent", None], 4), ([True, False, None], 20), ([True, False], 60)
PLATE, POLICY, DAY = (["34 ABC 123", "34ABC1", "kötü", None], 8), (["POL-2024-00001", "x", None], 32), (["2024-01-05", "05.01.2024", "2999-01-01", None], 1)
AMOUNT, DAMAGE, HURT, OTHER = (["100", "-5", "çok", None], 2), (["glass", "single_vehicle", "odd", None], 16), ([True, False, None], 1), ([True, None], 8)
CASES_SQL = "c AS (SELECT o_orderkey, " + ", ".join(
    f"{pick_sql(*x)} AS {n}"
    for n, x in {"content": CONTENT, "urgency": URGENCY, "flagged": FLAGGED, "hits": HITS, "plate": PLATE, "policy": POLICY, "day": DAY, "amount": AMOUNT, "damage": DAMAGE, "hurt": HURT, "other": OTHER}.items()
) + " FROM orders)"


def signals() -> Column:
    return F.when(pick(*HITS), F.array(F.lit("kanama"))).otherwise(no_texts())


@query(f"""
    WITH {CASES_SQL} SELECT o_orderkey, coalesce(content, 'claim') AS content_type,
    CASE WHEN content IS NULL THEN CASE WHEN hits THEN 'critical' ELSE 'normal' END WHEN hits OR flagged IS TRUE THEN 'critical' ELSE urgency END AS urgency,
    CASE WHEN content IS NULL THEN CASE WHEN hits THEN 'injury_override' ELSE 'fallback' END WHEN (hits OR flagged IS TRUE) AND urgency IS DISTINCT FROM 'critical' THEN 'injury_override' ELSE 'llm' END AS urgency_source FROM c
""")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and urgencies after signals, flags and missing answers."""
    found = rules.classify(pick(*CONTENT), pick(*URGENCY), pick(*FLAGGED), signals())
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("x")).select("o_orderkey", "x.*")


@query(rf"""
    WITH {CASES_SQL} SELECT o_orderkey, concat_ws(',',
    CASE WHEN NOT regexp_full_match(plate, '\d{{2}}\s?[A-ZÇĞİÖŞÜ]{{1,3}}\s?\d{{2,4}}') THEN 'invalid_plate_format' END, CASE WHEN NOT regexp_full_match(policy, 'POL-\d{{4}}-\d{{5}}') THEN 'invalid_policy_no_format' END,
    CASE WHEN day LIKE '%.%' THEN 'invalid_date_format' END, CASE WHEN day LIKE '2999%' THEN 'future_incident_date' END, CASE WHEN amount IS NOT NULL AND coalesce(TRY_CAST(amount AS DOUBLE), -1) < 0 THEN 'invalid_estimated_amount' END,
    CASE WHEN coalesce(urgency, '') NOT IN ('critical', 'high', 'normal') THEN 'invalid_urgency' END, CASE WHEN damage = 'odd' THEN 'invalid_damage_type' END,
    CASE WHEN coalesce(content, '') NOT IN ('claim', 'info_request', 'irrelevant') THEN 'invalid_content_type' END, CASE WHEN hurt IS NOT TRUE AND hits THEN 'injury_keyword_mismatch' END,
    CASE WHEN hurt AND urgency IS DISTINCT FROM 'critical' THEN 'injury_not_critical' END, CASE WHEN other AND damage = 'single_vehicle' THEN 'counterparty_single_vehicle_conflict' END,
    CASE WHEN content = 'claim' AND plate IS NULL AND day IS NULL THEN 'claim_missing_core_fields' END) AS flags FROM c
""")
def twelve_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve rules of validation on extractions with and without faults."""
    extraction = F.struct(
        pick(*PLATE).alias("plate"), pick(*POLICY).alias("policy_no"), pick(*DAY).alias("incident_date"), pick(*AMOUNT).alias("estimated_amount"), pick(*DAMAGE).alias("damage_type"), pick(*HURT).alias("injury"), pick(*OTHER).alias("counterparty_exists")
    )
    made = table(spark, sf_dir, "orders").select("o_orderkey", extraction.alias("x"), pick(*URGENCY).alias("urgency"), pick(*CONTENT).alias("content"), signals().alias("signals"))
    flags = rules.validation_flags(F.col("x"), F.col("urgency"), F.col("content"), F.col("signals"), F.lit("2025-01-01").cast("date"))
    return made.select("o_orderkey", F.array_join(F.transform(flags, lambda f: f["rule"]), ",").alias("flags"))


RULES = (["invalid_policy_no_format", "invalid_date_format", None], 16)
REASONS_SQL = """CASE WHEN content IS DISTINCT FROM 'claim' THEN 'not_a_claim' END, CASE WHEN urgency = 'critical' THEN 'critical_urgency' END, {sanity}
    CASE WHEN flagged IS NOT TRUE THEN 'no_extraction' END, CASE WHEN rule = 'invalid_date_format' THEN 'blocking_validation_flags' END, CASE WHEN damage = 'odd' THEN 'unverified_fields' END"""


@query(f"""
    WITH {CASES_SQL}, r AS (SELECT *, {pick_sql(*RULES)} AS rule FROM c) SELECT o_orderkey, concat_ws(',', {REASONS_SQL.format(sanity='')}) AS held,
    concat_ws(',', 'auto_approve_disabled', {REASONS_SQL.format(sanity="CASE WHEN hits THEN 'masking_sanity_flag' END,")}) AS held_when_off,
    concat_ws(',', CASE WHEN rule = 'invalid_policy_no_format' THEN rule END, CASE WHEN hits THEN 'masking_sanity_flag' END) AS advisory FROM r
""")
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason to hold a claim back: with the gate on and sanity advisory, and with the gate off and sanity blocking."""
    flags = rules.flags_of([("x", name, pick(*RULES) == name, F.lit(name)) for name in RULES[0] if name])
    given = (pick(*CONTENT), pick(*URGENCY), flags, F.when(pick(*DAMAGE) == "odd", F.array(F.lit("plate"))).otherwise(no_texts()), pick(*HITS), pick(*FLAGGED))
    made = table(spark, sf_dir, "orders").select("o_orderkey", rules.approval(*given, enabled=True).alias("on"), rules.approval(*given, enabled=False, sanity_blocks=True).alias("off"))
    return made.select("o_orderkey", F.array_join("on.reasons", ",").alias("held"), F.array_join("off.reasons", ",").alias("held_when_off"), F.array_join("on.advisory_flags", ",").alias("advisory"))


PHRASES = [" Dün", "bugün", "geçen hafta", "yarın", None]


@query(f"""
    WITH {CASES_SQL}, p AS (SELECT o_orderkey AS n, o_orderdate, flagged, hits, {pick_sql(PHRASES)} AS phrase FROM orders JOIN c USING (o_orderkey))
    SELECT n AS o_orderkey, CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 'hybrid' WHEN n % 2 = 0 THEN 'sql' ELSE 'retrieval' END AS route,
    CASE WHEN n % 3 = 0 THEN 'no_sources' WHEN flagged IS NOT TRUE THEN 'not_answerable' WHEN NOT n % 4 BETWEEN 1 AND n % 3 THEN 'no_valid_citation' END AS withheld,
    CASE WHEN n % 3 = 0 THEN 'empty_result' WHEN flagged IS NOT TRUE THEN 'not_answerable' WHEN n % 5 <> n % 3 AND n % 5 NOT IN (1, 2) THEN 'unverified_number' END AS sql_withheld,
    flagged IS TRUE AND n % 5 = 2 AS answered_right, flagged IS NOT TRUE AS refused_right, flagged IS TRUE AND n % 4 IN (1, 3) AS cited_right,
    CASE WHEN n % 10 < 5 AND hits THEN 'date,plate' WHEN n % 10 < 5 THEN 'plate' WHEN hits THEN 'date' ELSE '' END AS unsure,
    o_orderdate::DATE + CASE lower(trim(phrase)) WHEN 'dün' THEN -1 WHEN 'bugün' THEN 0 WHEN 'geçen hafta' THEN -7 END AS resolved_date FROM p
""")
def answer_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes, reasons to withhold an answer, scores of answers, unsure fields and relative dates."""
    known = spark.createDataFrame([("dün", -1), ("bugün", 0), ("Geçen hafta", -7)], "text string, offset int")
    answer = F.concat(F.lit("Toplam "), (key() % 5).cast("string"))
    confidence = F.create_map(F.lit("plate"), (key() % 10) / 10, F.lit("date"), F.lit(None).cast("double"))
    cited = F.array((key() % 4).cast("int"))
    named = F.when(pick(*HITS), F.array(F.lit("date"))).otherwise(no_texts())
    dated = answers.relative_date(pick(PHRASES), F.col("o_orderdate"), known, table(spark, sf_dir, "orders"))
    return dated.select(
        "o_orderkey", answers.route_mode(key() % 2 == 0, key() % 3 == 0).alias("route"), answers.retrieval_refusal(pick(*FLAGGED), (key() % 3).cast("int"), cited).alias("withheld"),
        answers.sql_refusal(pick(*FLAGGED), answer, F.lit("1. n: 2"), key() % 3).alias("sql_withheld"), answers.sql_answer_right(pick(*FLAGGED), answer, F.lit("2"), no_texts()).alias("answered_right"),
        answers.refusal_right(pick(*FLAGGED)).alias("refused_right"), answers.retrieval_answer_right(pick(*FLAGGED), cited, F.array(F.lit(1), F.lit(3))).alias("cited_right"),
        F.array_join(answers.low_confidence(named, confidence), ",").alias("unsure"), "resolved_date",
    )


CASE_SQL = f"WITH {RECORDS_SQL}, x AS (SELECT lang, toxic = 1 AS injury, list_contains(rules, 'shouting') OR list_contains(rules, 'symbols') AS critical, list_contains(rules, 'shouting') AS signalled FROM records)"


@query(CASE_SQL + """, r AS (
    SELECT 'all' AS label, count(*) FILTER (WHERE injury AND critical) AS numerator, count(*) FILTER (WHERE injury) AS denominator FROM x
    UNION ALL SELECT 'rules_alone', count(*) FILTER (WHERE injury AND signalled), count(*) FILTER (WHERE injury) FROM x
    UNION ALL SELECT 'false_alarms', count(*) FILTER (WHERE NOT injury AND critical), count(*) FILTER (WHERE NOT injury) FROM x
    UNION ALL SELECT 'corpus', 38, 38 UNION ALL SELECT coalesce(lang, 'unknown'), count(*) FILTER (WHERE critical), count(*) FROM x WHERE injury GROUP BY lang)
    SELECT label, numerator, denominator, round(numerator / nullif(denominator, 0), 6) AS value FROM r
""")
def critical_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline recall of what must not be missed, with what it is made of."""
    named = F.col("flags.rule")
    critical = F.array_contains(named, "shouting") | F.array_contains(named, "symbols")
    found = measures.critical_recall(records(spark, sf_dir), F.col("toxic") == 1, critical, F.array_contains(named, "shouting"), "lang")
    return found.withColumn("value", F.round("value", 6))


@query(f"WITH {RECORDS_SQL} SELECT doc_id FROM records WHERE toxic <> 1 AND len(list_filter(rules, lambda x: x <> 'not_english')) = 0 AND quality IS DISTINCT FROM 1")
def gate_wrong_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.gate_wrong_ids(records(spark, sf_dir).withColumn("d", decision()), F.col("d"), F.col("quality") == 1, "doc_id")


@query(f"""
    WITH {RECORDS_SQL}, s AS (SELECT count(*) FILTER (WHERE toxic = 1) AS leaks, count(*) FILTER (WHERE toxic = 1 AND len(rules) > 0) AS detected, count(*) FILTER (WHERE toxic <> 1) AS clean,
    count(*) FILTER (WHERE toxic <> 1 AND len(rules) > 0) AS false_alarms, count(*) FILTER (WHERE toxic = 1 AND list_contains(rules, 'not_english')) AS right_kind FROM records)
    SELECT *, round(coalesce(4 / nullif(clean, 0), 0), 6) AS noise FROM s
""")
def sanity_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, false alarms and kinds of flags, with the share that repeated runs differ by."""
    found = measures.sanity_measure(records(spark, sf_dir), F.col("toxic") == 1, F.size("flags") > 0, F.lit("not_english"), F.col("flags.rule"))
    return found.withColumn("noise", F.round(measures.noise_floor(F.col("clean")), 6))


@query(f"WITH {RECORDS_SQL} SELECT kind, count(*) AS records FROM (SELECT unnest(rules) AS kind FROM records) GROUP BY kind")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.kind_counts(records(spark, sf_dir), F.col("flags.rule"))


#: Statements for the guard over a table orders, and whether it lets them run.
STATEMENTS = {
    "SELECT count(*) FROM orders": True,
    "SELECT count(*) FROM orders; SELECT 1": False,
    "DROP TABLE orders": False,
    "INSERT INTO orders VALUES (1)": False,
    "SELECT o_orderkey FROM orders UNION SELECT o_orderkey FROM orders": False,
    "SELECT * FROM customer": False,
    "SELECT * FROM other.orders": False,
    "WITH x AS (SELECT * FROM orders) SELECT count(*) FROM x": True,
    "WITH x AS (SELECT * FROM customer) SELECT count(*) FROM x": False,
    "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)": False,
    "SELECT java_method('java.lang.System', 'exit', 1) FROM orders": False,
    "SELECT pg_sleep(10) FROM orders": False,
    "SELECT max(o_totalprice)::numeric FROM orders -- all": True,
    "": False,
}


@query("SELECT * FROM (VALUES " + ", ".join("('" + s.replace("'", "''") + f"', {ok})" for s, ok in STATEMENTS.items()) + ") AS t(statement, runs)")
def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guard says to each statement; one that may run is run."""

    def runs(sql: str) -> bool:
        try:
            return bool(guard.run(guard.guarded_sql(spark, sql, {"orders": lambda s: s.read.parquet(f"{sf_dir}/orders.parquet")})))
        except guard.Refused:
            return False

    return spark.createDataFrame([(s, runs(s)) for s in STATEMENTS], "statement string, runs boolean")


#: Questions about a status of orders, and whether the guard lets them run.
ASKED = (
    ("SELECT count(*) AS n FROM orders WHERE o_orderstatus = '{}'", True),
    ("WITH x AS (SELECT * FROM orders WHERE o_orderstatus = '{}') SELECT count(*) AS n FROM x -- one statement", True),
    ("SELECT count(*) AS n FROM orders WHERE o_orderstatus = '{}'; SELECT 1", False),
    ("DELETE FROM orders WHERE o_orderstatus = '{}'", False),
    ("SELECT count(*) AS n FROM orders WHERE o_orderstatus = '{}' UNION SELECT 1", False),
    ("SELECT count(reflect('java.lang.System', 'gc')) AS n FROM orders WHERE o_orderstatus = '{}'", False),
    ("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = '{}'", False),
    ("SELECT count(*) AS n FROM (SELECT * FROM parquet.`/tmp/x`) WHERE o_orderstatus = '{}'", False),
)


@query(f"""
    WITH q AS (SELECT unnest(range({len(ASKED)}))::INT AS question)
    SELECT o_orderstatus AS status, question, question < 2 AS runs, CASE WHEN question < 2 THEN count(*) END AS n FROM orders, q GROUP BY o_orderstatus, question
""")
def guarded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question about each status of the table gives: a count, or a refusal."""
    statuses = [r[0] for r in table(spark, sf_dir, "orders").select("o_orderstatus").distinct().collect()]
    views = {"orders": lambda s: s.read.parquet(f"{sf_dir}/orders.parquet")}

    def answer(sql: str) -> tuple[bool, int | None]:
        try:
            return True, guard.run(guard.guarded_sql(spark, sql, views))[0]["n"]
        except guard.Refused:
            return False, None

    rows = [(s, k, *answer(sql.format(s))) for s in statuses for k, (sql, _) in enumerate(ASKED)]
    return spark.createDataFrame(rows, "status string, question int, runs boolean, n long")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def forced_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that asks for more rows than the guard gives."""
    return guard.guarded_sql(spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 250", {"orders": lambda s: s.read.parquet(f"{sf_dir}/orders.parquet")})
