"""Windows over event time; the stream gives what the batch gives."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import quantiles
from claimloom.plans.registry import query, table
from claimloom.sources.shared import scratch
from claimloom.streaming import gauges, keyed, metrics, queue, waits, windows

HOURLY_SQL = """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, event_type, count(*) AS n, round(count(*) / 3600.0, 9) AS per_second FROM events GROUP BY ALL
"""


def _hourly(events: DataFrame) -> DataFrame:
    return windows.rates(events, "ts", "event_type", "1 hour").select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "n", F.round("per_second", 9).alias("per_second"))


@query(HOURLY_SQL)
def hourly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(table(spark, sf_dir, "events"))


@query(HOURLY_SQL)
def streamed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of files, in complete mode."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = scratch(spark, "rates")
    running = windows.keep_whole(_hourly(events), folder).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.parquet(f"{folder}/result")


@query("""
    WITH s AS (SELECT event_type, ts, unnest(range(0, 300, 60)) AS back FROM events)
    SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_seconds(back) AS begins, event_type, count(*) AS n FROM s GROUP BY ALL
""")
def sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five minutes that begin every minute."""
    return windows.rates(table(spark, sf_dir, "events"), "ts", "event_type", "5 minutes", "1 minute").select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "n")


@query("SELECT ts::DATE::TIMESTAMP AS begins, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each day."""
    return windows.quantiles(table(spark, sf_dir, "events"), "ts", "value", "1 day").withColumn("begins", F.col("begins").cast("timestamp_ntz"))


@query("""
    SELECT event_type, ((day(ts) - 1) // 8)::INT AS part, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.999) AS p999
    FROM events GROUP BY ALL
""")
def range_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each type over ranges of eight days, from summaries that are kept for each day."""
    events = table(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("day"), "value")
    daily = quantiles.summary(events, ["event_type", "day"], "value")
    part = F.expr("(day - 1) DIV 8").cast("int").alias("part")
    over = quantiles.merged(daily.withColumn("part", part), ["event_type", "part"])
    ranks = {f"p{name}": quantiles.disc(share) for name, share in (("50", 0.5), ("95", 0.95), ("999", 0.999))}
    found = quantiles.at_ranks(events.withColumn("part", part), over, ["event_type", "part"], "value", ranks)
    return found.join(over.groupBy("event_type", "part").agg(F.sum("n").alias("n")), ["event_type", "part"])


@query("""
    WITH b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 1000000.0]) AS le) GROUP BY ALL),
    t AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, lag(n, 1, 0) OVER w AS under, lag(le, 1, 0.0) OVER w AS lower FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, round(arg_min(lower + (le - lower) * (0.95 * total - under) / (n - under), le), 6) AS quantile FROM t WHERE n >= total * 0.95 GROUP BY event_type
""")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of each type as its histogram shows it."""
    bounds = [10.0, 25.0, 50.0, 100.0, 250.0, 1_000_000.0]
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(bounds)])
    buckets = counts.select("event_type", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)])))
    return windows.bucket_quantile(buckets, "event_type", "le", "n").select("event_type", F.round("quantile", 6).alias("quantile"))


#: The events arrive in lots, eight days at a time.
LOT_SQL = "(day(ts) - 1) // 8"


def lots(spark: SparkSession, sf_dir: str, folder: str) -> Iterator[DataFrame]:
    """A stream of the events below folder/in for each lot that has arrived there."""
    events = table(spark, sf_dir, "events")
    for lot in range(4):
        events.where(F.expr("(day(ts) - 1) DIV 8") == lot).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(events.schema).parquet(f"{folder}/in")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def streamed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user after four batches that rewrite the buckets they touch."""
    folder = scratch(spark, "upserts")
    kept = keyed.KeyedTable(spark, f"{folder}/table", "user_id long, event_id long, event_type string, value double, ts timestamp_ntz", "user_id", ("ts", "event_id"), 16)
    for stream in lots(spark, sf_dir, folder):
        kept.written_by(stream, f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return kept.read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order by its key, from the one bucket that holds it."""
    orders = table(spark, sf_dir, "orders")
    kept = keyed.KeyedTable(spark, scratch(spark, "orders"), "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz", "o_orderkey", ("o_orderdate",), 16)
    kept.merge(orders)
    return kept.lookup(orders.agg(F.max("o_orderkey")).first()[0]).drop("o_orderdate")


WAITS_SQL = """
    pairs AS (
        SELECT r.user_id, r.event_id AS routed_event, d.event_id AS decided_event, round((epoch_us(d.ts) - epoch_us(r.ts)) / 1e6, 6) AS wait_s
        FROM (SELECT * FROM events WHERE event_type = 'view') r
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') d ON r.user_id = d.user_id AND d.ts >= r.ts AND d.ts <= r.ts + INTERVAL 12 HOURS)
"""


@query(f"WITH {WAITS_SQL} SELECT * FROM pairs")
def routed_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every routing with its decisions within twelve hours, or with none."""
    events = table(spark, sf_dir, "events")
    found = waits.waits(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "12 hours")
    return found.select("user_id", "routed_event", "decided_event", F.round("wait_s", 6).alias("wait_s"))


@query(f"WITH {WAITS_SQL} SELECT * FROM pairs")
def streamed_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two streams; a heartbeat of either type after the last event lets go of what was never decided."""
    folder = scratch(spark, "waits")
    both = lambda stream: (stream.where(f"event_type = '{kind}'") for kind in ("view", "purchase"))

    def advance(stream: DataFrame) -> None:
        found = waits.waits(*both(stream), "user_id", "ts", "event_id", "12 hours")
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/result").trigger(availableNow=True).start().awaitTermination()

    for stream in lots(spark, sf_dir, folder):
        advance(stream)
    events = table(spark, sf_dir, "events")
    kinds = F.explode(F.map_from_arrays(F.array(F.lit("view"), F.lit("purchase")), F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))))
    end = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), kinds.alias("event_type", "user_id"))
    columns = [F.col(c) if c in end.columns else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns]
    end.select(*columns).write.mode("append").parquet(f"{folder}/in")
    advance(stream)
    return spark.read.parquet(f"{folder}/result").where("routed_event IS NOT NULL").select("user_id", "routed_event", "decided_event", F.round("wait_s", 6).alias("wait_s"))


@query("""
    WITH waits AS (
        SELECT d.event_id, d.ts, min(epoch_us(d.ts) - epoch_us(r.ts)) AS wait
        FROM events d JOIN events r ON r.event_type = 'view' AND d.event_type = 'purchase' AND r.user_id = d.user_id AND d.ts >= r.ts AND d.ts <= r.ts + INTERVAL 12 HOURS
        GROUP BY d.event_id, d.ts)
    SELECT ts::DATE AS day, count(*) AS decisions, round(avg(wait / 1e6), 3) AS mean_wait_s FROM waits GROUP BY ALL
""")
def daily_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean seconds from the last routing to each decision, by day."""
    events = table(spark, sf_dir, "events")
    pairs = waits.waits(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "12 hours")
    return waits.last_routed(pairs).groupBy(F.to_date("decided_at").alias("day")).agg(F.count("*").alias("decisions"), F.round(F.avg("wait_s"), 3).alias("mean_wait_s"))


@query(f"""
    WITH so_far AS (SELECT lot, user_id, arg_max(event_type, (ts, event_id)) AS status FROM events JOIN (SELECT unnest(range(4)) AS lot) ON {LOT_SQL} <= lot GROUP BY ALL)
    SELECT lot::INT AS lot, status, count(*) AS n FROM so_far GROUP BY ALL
""")
def streamed_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users have each status as their last, after each of four lots, from the differences that the lots make."""
    folder = scratch(spark, "gauges")
    counts, found = gauges.Gauges(spark, f"{folder}/counts"), None
    for lot, stream in enumerate(lots(spark, sf_dir, folder)):
        counts.following(stream, "user_id", "event_type", "ts", "event_id", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
        after = counts.read().withColumn("lot", F.lit(lot))
        found = after if found is None else found.unionByName(after)
    return found


VALUE_BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0)


@query("""
    SELECT le, count(*) FILTER (WHERE value <= le) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS total
    FROM events, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 1e300])::DOUBLE AS le) GROUP BY le
""")
def observed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and cumulative buckets that four batches of a stream report of themselves."""
    folder, totals = scratch(spark, "observed"), metrics.Totals(VALUE_BOUNDS)
    for stream in lots(spark, sf_dir, folder):
        seen = metrics.observed(stream, {"errors": F.col("event_type") == "error"}, F.col("value"), VALUE_BOUNDS)
        running = seen.select("event_id").writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/result").trigger(availableNow=True).start()
        running.awaitTermination()
        totals.take(running.recentProgress)
    found = totals.totals()
    rows = [(min(b, 1e300), n, int(found["counter_errors"]), round(found["sum"], 4)) for b, n in totals.histogram()]
    return spark.createDataFrame(rows, "le double, n long, errors long, total double")


@query("""
    WITH so_far AS (SELECT lot, count(*) FILTER (WHERE (day(ts) - 1) // 8 <= lot) AS come, count(*) FILTER (WHERE (day(ts) - 1) // 8 < lot) AS done FROM events, (SELECT unnest(range(4)) AS lot) GROUP BY lot)
    SELECT lot::INT AS lot, come, come - done AS waiting, 0::BIGINT AS waiting_after, come AS read FROM so_far
""")
def queue_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits in a queue before and after each of four batches, each read by a stream that starts again."""
    folder = scratch(spark, "queue")
    waiting, rows = queue.Queue(spark, f"{folder}/queue"), []
    for lot in range(4):
        come = waiting.put(table(spark, sf_dir, "events").where(F.expr("(day(ts) - 1) DIV 8") == lot).select(F.col("event_id").alias("id")))
        before = waiting.depth()
        waiting.stream().writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/result").trigger(availableNow=True).start().awaitTermination()
        waiting.settle(f"{folder}/progress")
        rows.append((lot, come, before, waiting.depth(), spark.read.parquet(f"{folder}/result").select("id").distinct().count()))
    return spark.createDataFrame(rows, "lot int, come long, waiting long, waiting_after long, read long")
