"""Operational metrics over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from claimloom.operators import quantiles as exact


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """events with `at` as a timestamp and, on a stream, a watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late) if events.isStreaming else timed


def rates(events: DataFrame, at: str, key: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each key and window, and their rate a second. On a stream, what comes later than `late` is left out."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    found = _timed(events, at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return found.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), key, "n", (F.col("n") / seconds).alias("per_second"))


def quantiles(events: DataFrame, at: str, value: str, width: str = "5 minutes", shares: tuple[float, ...] = (0.5, 0.95), late: str = "10 minutes") -> DataFrame:
    """Quantiles of a value in each window, as columns p50, p95, ...: exact ones of a table. A stream passes each event once, so that those of a window with
    over 10,000 different values are approximate there; summaries of quantiles.summary() that a batch keeps give exact ones later."""
    names = {f"p{s * 100:g}": s for s in shares}
    if events.isStreaming:
        found = _timed(events, at, late).groupBy(F.window(at, width).alias("w"))
        return found.agg(*[F.percentile_approx(value, s, 10_000).alias(n) for n, s in names.items()]).select(F.col("w.start").alias("begins"), *names)
    begun = _timed(events, at, late).select(F.window(at, width)["start"].alias("begins"), value)
    return exact.quantiles(begun, ["begins"], value, {n: exact.disc(s) for n, s in names.items()})


def bucket_quantile(buckets: DataFrame, key: str, bound: str, count: str, share: float = 0.95) -> DataFrame:
    """Quantile from cumulative histogram buckets (bound, count), with a straight line inside the bucket."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(bound).alias("le"), F.col(count).cast("double").alias("n"))))
    found = buckets.groupBy(key).agg(rows.alias("b"))
    total = F.element_at("b", -1)["n"]
    at = F.array_position(F.transform("b", lambda x: x["n"] >= total * share), True).cast("int")
    lower = F.when(at > 1, F.get("b", at - 2)["le"]).otherwise(0.0)
    under = F.when(at > 1, F.get("b", at - 2)["n"]).otherwise(0.0)
    here = F.get("b", at - 1)
    part = F.try_divide(total * share - under, here["n"] - under)
    return found.select(key, F.when(here["le"] == float("inf"), lower).otherwise(lower + (here["le"] - lower) * part).alias("quantile"))


def cost(events: DataFrame, at: str, units: str, price: float, until: Column) -> DataFrame:
    """Units of the last 24 hours times price, 0 for none."""
    return events.where(F.col(at) > until - F.expr("INTERVAL 24 HOURS")).agg((F.coalesce(F.sum(units), F.lit(0)) * price).alias("cost"))


def gauges(claims: DataFrame, audit: DataFrame) -> DataFrame:
    """in_review, approved and rejected in one row."""
    a = claims.agg(F.count_if(F.col("status") == "in_human_review").alias("in_review"))
    b = audit.agg(F.count_if(F.col("step") == "approve").alias("approved"), F.count_if(F.col("step") == "reject").alias("rejected"))
    return a.join(F.broadcast(b))  # one row each


def replay(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream that gives a few of the folder's Parquet files a batch, in place of a message queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_whole(df: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that keeps the whole result of a streamed aggregation as Parquet in `folder`/result, replaced by each batch,
    and its progress beside it; nothing of it goes through the driver."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    return df.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").foreachBatch(write)
