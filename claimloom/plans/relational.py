"""Projections, predicates, joins, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.text import three_valued
from claimloom.functions.vectors import similarity_score
from claimloom.operators import joins, measures, ranking, retrieval, rules, views
from claimloom.operators.numbering import numbered
from claimloom.operators.views import json_decimal, json_text
from claimloom.plans.guard import guarded_sql
from claimloom.plans.registry import query, table


@query("""
    SELECT event_id, event_type, ts, c_custkey, c_mktsegment, json_extract_string(props, '$.k') AS k_text,
           TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(38,10))::DOUBLE AS k_number,
           CASE WHEN lower(json_extract_string(props, '$.flag')) = 'true' THEN true WHEN lower(json_extract_string(props, '$.flag')) = 'false' THEN false END AS flag
    FROM events JOIN customer ON user_id = c_custkey
""")
def flat_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document as typed columns, a value that does not fit as null, joined to its parent."""
    props = F.col("props")
    joined = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return joined.select(
        "event_id", "event_type", "ts", "c_custkey", "c_mktsegment", json_text(props, "k").alias("k_text"), json_decimal(props, "k").cast("double").alias("k_number"), three_valued(json_text(props, "flag")).alias("flag")
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.matching(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IS DISTINCT FROM '5-LOW'")
def phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.matching(table(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, {"o_orderpriority": "5-LOW"}).select("o_orderkey")


@query("""
    SELECT count(*) FILTER (WHERE toxic IS NULL) AS without, count(*) FILTER (WHERE toxic IS NOT NULL) AS with_label,
           count(*) FILTER (WHERE (toxic = 1) IS TRUE) AS is_true, count(*) FILTER (WHERE (toxic = 1) IS FALSE) AS is_false
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    toxic = F.col("toxic") == 1
    return joined.agg(
        F.count_if(toxic.isNull()).alias("without"), F.count_if(toxic.isNotNull()).alias("with_label"), F.count_if(toxic.eqNullSafe(True)).alias("is_true"), F.count_if(toxic.eqNullSafe(False)).alias("is_false")
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE 'eco%my'")
def case_blind_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("eco%my")).select("p_partkey", "p_name")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY AND event_type IN ('error', 'signup')")
def recent_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts")).scalar()
    return events.where((F.col("ts") >= last - F.expr("INTERVAL 3 DAYS")) & F.col("event_type").isin("error", "signup")).select("event_id", "user_id")


@query("""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN quality IS NOT NULL THEN 'quality' END, CASE WHEN toxic IS NOT NULL THEN 'toxic' END, CASE WHEN lang IS NOT NULL THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS filled,
           array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    return joined.select("doc_id", F.array_join(rules.filled_names({"quality": q, "toxic": t, "lang": F.col("lang")}), ",").alias("filled"), F.array_join(rules.null_names({"quality": q, "toxic": t}), ",").alias("missing"))


@query("""
    SELECT o_orderkey, o_orderstatus AS before, CASE WHEN o_totalprice < 0 THEN o_orderstatus ELSE 'F' END AS after
    FROM orders WHERE o_orderstatus <> 'F'
""")
def edited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit of a nested field, listed only where it changes something."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("claim"))
    edited = rules.edit(orders, "claim", {"status": F.lit("F")}, {"status": F.col("claim.price") >= 0})
    return edited.select("o_orderkey", F.inline("changes")).select("o_orderkey", "before", "after")


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 = 0 THEN 'approved' WHEN o_orderstatus = 'O' AND o_orderkey % 10 = 1 THEN 'archived'
           WHEN o_orderstatus = 'O' THEN 'in_human_review' ELSE o_orderstatus END AS status FROM orders
""")
def decided_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after a round of decisions, of which only those on claims in review take effect."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "in_human_review").otherwise(F.col("o_orderstatus"))
    claims = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))
    decided = orders.where("o_orderkey % 10 < 2").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 10 == 0, "approve").otherwise("reject").alias("action"))
    return rules.transition(claims, decided, F.current_timestamp())[0].select("id", "status")


@query("""
    SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def chained_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.missing_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the documents that they are about, none without."""
    labels = table(spark, sf_dir, "labels")
    about = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi")
    return joins.strict_join(about, labels, "doc_id").select("doc_id", "source", "quality")


@query("SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("""
    SELECT c_custkey, coalesce(s.s_name, (SELECT max(s_name) FROM supplier WHERE s_suppkey % 10 = 1)) AS payload
    FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 1) s ON c_custkey = s.s_suppkey
""")
def recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's own recorded answer, or else the one for all others."""
    s = table(spark, sf_dir, "supplier")
    key = F.when(F.col("s_suppkey") % 10 == 1, "*").otherwise(F.col("s_suppkey").cast("string"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("gt_id"))
    return joins.lookup_with_default(asked, s.select(key.alias("gt_id"), F.col("s_name").alias("payload")), "gt_id").select("c_custkey", "payload")


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS flags, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def grouped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mappings of each message, gathered in order."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("f"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("x"), F.count("*").alias("n")).select("l_orderkey", F.array_join("x.f", ",").alias("flags"), "n")


@query("SELECT row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS position, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 50 = 0")
def pinned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a pinned list of ids, in the list's order, which is numbered by ranges."""
    orders = table(spark, sf_dir, "orders")
    ids = orders.where("o_orderkey % 50 = 0").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("by"))
    ids = numbered(ids, "by", "o_orderkey").drop("by")
    return joins.in_order_of(orders, "o_orderkey", ids).select("position", "o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey, o_custkey FROM orders")
def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their place by price, without one task that sees them all."""
    return numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", name="place").drop("o_totalprice")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key, as an upsert by key leaves it."""
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return joins.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id", "at", "event_type").select("user_id", "event_id", "event_type")


@query("""
    WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 4) AS score, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS exact FROM embeddings, q WHERE label < 5)
    SELECT vec_id, score FROM s ORDER BY exact DESC, vec_id LIMIT 10
""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to one, filtered before they are ranked."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = F.array(*map(F.lit, vectors.where("vec_id = 0").first()["embedding"]))
    return ranking.nearest(vectors.where("label < 5"), asked, "embedding", "vec_id", 10).select("vec_id", "score")


@query("""
    WITH q AS (SELECT vec_id AS question, label, embedding AS qe FROM embeddings WHERE vec_id < 50),
    s AS (SELECT question, e.vec_id, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS score FROM embeddings e, q)
    SELECT question, k::INT AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 10
""")
def nearest_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each of fifty questions."""
    vectors = table(spark, sf_dir, "embeddings")
    questions = vectors.where("vec_id < 50").select(F.col("vec_id").alias("question"), "embedding")
    return retrieval.search_many(vectors, questions, "vec_id", "embedding", "question", 10, block=20).withColumn("score", F.round("score", 6))


@query("""
    WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)
    SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]) DESC, vec_id) AS k FROM embeddings, q) WHERE k = 1
""")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = F.array(*map(F.lit, vectors.where("vec_id = 0").first()["embedding"]))
    return ranking.best_of_group(vectors, "label", asked, "embedding", "vec_id").select("label", "vec_id")


@query("""
    WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 1)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 4) AS score FROM embeddings, q
""")
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = F.array(*map(F.lit, vectors.where("vec_id = 1").first()["embedding"]))
    return vectors.select("vec_id", similarity_score(F.col("embedding"), asked).alias("score"))


@query("""
    SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 5
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_sample(table(spark, sf_dir, "documents"), "lang", "doc_id", 5).select("lang", "doc_id")


@query("""
    SELECT quality, doc_id, CASE WHEN k <= 4 THEN 'tune' ELSE 'holdout' END AS split
    FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS k FROM labels) WHERE k <= 10
""")
def tune_and_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.split_slices(table(spark, sf_dir, "labels"), "quality", "doc_id", 4, 6).select("quality", "doc_id", "split")


@query("""
    WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20),
    b AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY o_orderkey LIMIT 20)
    SELECT 0 AS phase, o_orderkey FROM a UNION ALL SELECT 1, o_orderkey FROM b
""")
def replay_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = [{"equal": {"o_orderstatus": "O"}, "count": 20}, {"equal": {"o_orderpriority": "1-URGENT"}, "count": 20}]
    return ranking.take_phases(table(spark, sf_dir, "orders"), phases, "o_orderkey").select("phase", "o_orderkey")


@query("""
    WITH a AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, o_orderkey, place, greatest(n - 20, 0) AS more FROM a WHERE place <= 20
""")
def capped_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 examples of each group and how many more there are; counts are aggregated, only a top-k is ordered."""
    orders = table(spark, sf_dir, "orders")
    first = orders.select("o_orderpriority", "o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")).cast("long").alias("place")).where("place <= 20")
    counts = orders.groupBy("o_orderpriority").agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("more"))
    return first.join(counts, "o_orderpriority")


@query("""
    WITH a AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_custkey)
    SELECT o_custkey, len(list_intersect(s, ['F', 'O'])) AS both_sides, len(list_filter(s, lambda x: NOT list_contains(['F'], x))) AS only_left,
           len(list_distinct(list_concat(s, ['F', 'X']))) AS united, list_has_any(s, ['P']) AS overlaps FROM a
""")
def set_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    of = lambda *x: F.array(*map(F.lit, x))
    s = F.col("s")
    return sets.select(
        "o_custkey", F.size(F.array_intersect(s, of("F", "O"))).cast("long").alias("both_sides"), F.size(F.array_except(s, of("F"))).cast("long").alias("only_left"), F.size(F.array_sort(F.array_union(s, of("F", "X")))).cast("long").alias("united"), F.arrays_overlap(s, of("P")).alias("overlaps")
    )


@query("SELECT name FROM (SELECT c_mktsegment AS name FROM customer UNION SELECT n_name FROM nation)")
def dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    return a.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).distinct()


@query("""
    WITH late AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
    SELECT c_mktsegment AS segment, count(*) AS customers, sum(n)::BIGINT AS open_orders, round(avg(c_acctbal), 2) AS mean_balance
    FROM customer JOIN late ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY segment
""")
def guarded_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question in SQL, with a CTE, a join and a bare numeric cast, through the guard."""
    sql = """```sql
        WITH late AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
        SELECT c_mktsegment AS segment, count(*) AS customers, sum(n) AS open_orders, round(avg(c_acctbal)::numeric, 2)::double AS mean_balance
        FROM customer JOIN late ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY segment -- a comment
    ```"""
    views = {n: (lambda s, n=n: s.read.parquet(f"{sf_dir}/{n}.parquet")) for n in ("orders", "customer")}
    return guarded_sql(spark, sql, views)


@query("SELECT count(*) AS pairs, count(l.doc_id) AS labelled, count(DISTINCT d.source) AS sources FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(F.count("*").alias("pairs"), F.count("quality").alias("labelled"), F.countDistinct("source").alias("sources"))


@query("""
    SELECT d.doc_id, coalesce(d.lang, 'unknown') AS lang, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, 'belirtilmemiş') AS quality
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default for what a left join does not find."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return joined.select("doc_id", measures.or_unknown(F.col("lang")).alias("lang"), F.coalesce(quality, F.lit("belirtilmemiş")).alias("quality"))


@query("""
    SELECT o_orderkey AS id, 'web' AS channel, 'claim' AS content_type, o_orderpriority AS urgency, o_orderstatus AS status, 'done' AS message_status,
           'P-' || o_custkey AS policy_no, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE END AS incident_date,
           CASE WHEN o_orderkey % 2 = 0 THEN 'Ankara' END AS city, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS injury,
           CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS estimated_amount
    FROM orders
""")
def claims_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat view over claims whose JSON holds good and bad dates, numbers and booleans: what does not fit is null."""
    n = F.col("o_orderkey")
    date = F.when(n % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n % 4 == 1, "31.12.2024").when(n % 4 == 2, "2024-13-41")
    injury = F.when(n % 5 == 0, "True").when(n % 5 == 1, "false").when(n % 5 == 2, "belki").when(n % 5 == 3, "")
    amount = F.when(n % 3 == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).when(n % 3 == 1, "çok")
    place = F.struct(F.when(n % 2 == 0, "Ankara").alias("city"))
    fields = F.struct(F.concat(F.lit("P-"), "o_custkey").alias("policy_no"), date.alias("incident_date"), place.alias("incident_location"), injury.alias("injury"), amount.alias("estimated_amount"))
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    claims = orders.select(
        n.alias("id"), n.alias("raw_message_id"), F.lit("web").alias("channel"), F.lit("claim").alias("content_type"), F.col("o_orderpriority").alias("urgency"), F.col("o_orderstatus").alias("status"), at.alias("created_at"), at.alias("updated_at"), F.to_json(F.struct(fields.alias("extraction"))).alias("data")
    )
    messages = orders.select(n.alias("id"), F.lit("done").alias("status"), at.alias("received_at"))
    flat = views.claims_flat(claims, messages)
    return flat.select("id", "channel", "content_type", "urgency", "status", "message_status", "policy_no", "incident_date", "city", "injury", F.col("estimated_amount").cast("double").alias("estimated_amount"))
