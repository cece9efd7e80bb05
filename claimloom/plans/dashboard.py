"""Dashboard, queue and operations queries, over orders and events in the place of claims and their audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import measures, ranking
from claimloom.operators.views import json_text
from claimloom.plans.registry import query, table

PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
RANK_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


@query("""
    SELECT 'status' AS section, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
    UNION ALL SELECT 'day', strftime(ts::DATE, '%Y-%m-%d'), count(*) FROM events
              WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ts::DATE
""")
def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and by urgency, and the trend of the last week."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    last = events.agg(F.max("ts")).scalar()
    trend = measures.daily_trend(events, "ts", last).select(F.lit("day").alias("section"), F.date_format("day", "yyyy-MM-dd").alias("name"), "n")
    both = [measures.counts_by(orders, F.col(c).alias("name")).select(F.lit(s).alias("section"), "name", "n") for s, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]
    return both[0].unionByName(both[1]).unionByName(trend)


@query("SELECT coalesce(nullif(o_orderstatus, ''), 'unknown') AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.counts_by(table(spark, sf_dir, "orders"), measures.or_unknown(F.col("o_orderstatus")).alias("status"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select(json_text(F.col("props"), "k").alias("k")).where("k is not null")
    return measures.counts_by(keyed, "k")


@query("SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return measures.daily_trend(events, "ts", events.agg(F.max("ts")).scalar())


@query("SELECT max(ts) AS last_update, count(*) AS total FROM events")
def last_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.max("ts").alias("last_update"), F.count("*").alias("total"))


@query("""
    SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders
    WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40
""")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of open orders, newest first, with how many there are."""
    rows = ranking.matching(table(spark, sf_dir, "orders"), {"o_orderstatus": "O", "o_orderpriority": None})
    page = ranking.page(rows.select("o_orderkey", "o_orderdate"), F.desc("o_orderdate"), F.asc("o_orderkey"), limit=20, offset=40)
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query(f"""
    SELECT o_orderkey, {RANK_SQL} AS urgency_rank, o_orderdate FROM orders WHERE o_orderstatus = 'O'
    ORDER BY urgency_rank, o_orderdate, o_orderkey LIMIT 50
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("urgency_rank", ranking.rank_of(F.col("o_orderpriority"), PRIORITIES))
    return ranking.page(waiting.select("o_orderkey", "urgency_rank", "o_orderdate"), F.asc("urgency_rank"), F.asc("o_orderdate"), F.asc("o_orderkey"), limit=50)


@query("""
    SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS in_review,
           (SELECT count(*) FROM events WHERE event_type = 'purchase') AS approved,
           (SELECT count(*) FROM events WHERE event_type = 'error') AS rejected
""")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("in_review"))
    b = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "purchase").alias("approved"), F.count_if(F.col("event_type") == "error").alias("rejected"))
    return a.join(F.broadcast(b))


@query("""
    WITH decided AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, user_id DESC LIMIT 100),
    routed AS (SELECT user_id, max(ts) AS begun FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT round(coalesce(avg((epoch_us(d.ts) - epoch_us(r.begun)) / 1e6), 0), 3) AS mean_wait_s, count(*) AS n
    FROM decided d JOIN routed r USING (user_id)
""")
def mean_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = measures.wait_times(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", "ts")
    return found.withColumn("mean_wait_s", F.round("mean_wait_s", 3))


@query("SELECT event_id, ts FROM events WHERE event_type IN ('purchase', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query("""
    SELECT count(*) AS n, max(o_totalprice) AS highest, min(o_totalprice) AS lowest, round(sum(o_totalprice), 2) AS total,
           round(avg(o_totalprice), 2) AS mean, count(DISTINCT o_custkey) AS customers FROM orders
""")
def flat_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n"), F.max(price).alias("highest"), F.min(price).alias("lowest"), F.round(F.sum(price), 2).alias("total"), F.round(F.avg(price), 2).alias("mean"), F.countDistinct("o_custkey").alias("customers")
    )


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY n DESC, segment LIMIT 1")
def most_frequent_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return measures.counts_by(joined, F.col("c_mktsegment").alias("segment")).orderBy(F.desc("n"), "segment").limit(1)


@query("SELECT event_type AS step, round(avg(value), 6) AS mean_value, count(value) AS n FROM events GROUP BY ALL")
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("value").alias("n"))


@query("""
    WITH sums AS (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id)
    SELECT round(quantile_cont(total, 0.95), 6) AS percentile, round(avg(total), 6) AS mean, count(*) AS entities FROM sums
""")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.entity_percentile(table(spark, sf_dir, "events"), "user_id", "value")
    return found.select(F.round("percentile", 6).alias("percentile"), F.round("mean", 6).alias("mean"), "entities")


@query("""
    WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT max(n) AS n, max(CASE WHEN k = least(n - 1, floor(n * 0.95)) THEN value END) AS p95, max(CASE WHEN k = n // 2 THEN value END) AS median FROM v
""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.nearest_rank(table(spark, sf_dir, "events"), "value")


@query("SELECT sum(n)::BIGINT AS grand_total, count(*) AS statuses FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(spark, sf_dir).agg(F.sum("n").alias("grand_total"), F.count("*").alias("statuses"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL")
def seeded_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of those orders that a list of references names."""
    refs = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select("o_orderkey")
    return measures.counts_by(table(spark, sf_dir, "orders").join(refs, "o_orderkey", "left_semi"), F.col("o_orderstatus").alias("status"))


@query("SELECT round(coalesce(sum(value), 0) * 0.15, 6) AS cost FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.streaming.windows import cost

    events = table(spark, sf_dir, "events")
    return cost(events, "ts", "value", 0.15, events.agg(F.max("ts")).scalar()).select(F.round("cost", 6).alias("cost"))
