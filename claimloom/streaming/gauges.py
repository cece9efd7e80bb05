"""Gauges that move: how many keys have each status, kept by the difference that each change makes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from claimloom.sources.shared import Store
from claimloom.streaming.keyed import KeyedTable

STALE = "stale"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which changes() needs; the session's setting is as before afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class LastStatus(StatefulProcessor):
    """Keeps the last status of a key and gives what leaves and joins each gauge. A key whose status has not changed for
    `stale_ms` joins the gauge `stale` beside its own, until it changes."""

    def __init__(self, stale_ms: int | None) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "status string, at long, tie string, stale boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        status, at, tie, stale = held or (None, None, None, False)
        last = (status, at, tie)
        for part in rows:
            for row in zip(part["status"], part["at_us"], part["tie"], strict=True):
                if last[1] is None or (row[1], row[2]) > (last[1], last[2]):
                    last = row
        if last == (status, at, tie):
            return
        moved = [] if last[0] == status else [(s, n) for s, n in ((status, -1), (last[0], 1)) if s is not None]
        if stale:
            moved.append((STALE, -1))
        if self.stale_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            due = int(last[1]) // 1000 + self.stale_ms
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        self.state.update((last[0], int(last[1]), last[2], False))
        if moved:
            yield pd.DataFrame(moved, columns=["status", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at, tie, stale = self.state.get()
        if not stale:
            self.state.update((status, at, tie, True))
            yield pd.DataFrame([(STALE, 1)], columns=["status", "change"])

    def close(self) -> None:
        pass


def changes(events: DataFrame, key: str, status: str, at: str, tie: str, stale_after: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(status, change): what each batch of a stream adds to the gauges. The last event of a key in order of `at`, then `tie`, holds; events that come
    late are taken if they are the last all the same, null keys and statuses are left out.

    Each batch moves the events of its keys and the state of those keys only. With stale_after (an interval), timers in event time count what has not changed."""
    rows = events.where(F.col(key).isNotNull() & F.col(status).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(status).cast("string").alias("status"), F.col(at).cast("timestamp").alias("at"), F.col(tie).cast("string").alias("tie"))
    rows = rows.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    stale_ms = None if stale_after is None else int(pd.Timedelta(stale_after).total_seconds() * 1000)
    mode = "None" if stale_after is None else "EventTime"
    return rows.groupBy("key").transformWithStateInPandas(LastStatus(stale_ms), "status string, change long", "Update", mode)


class Gauges:
    """Counts by status in a folder of the shared store, a small file a batch. A batch that is run again gives the file it gave before."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.store = spark, folder, Store(spark, folder)

    def _batches(self) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in self.store.names() if n.startswith("batch="))

    def read(self, batch: int | None = None) -> DataFrame:
        """(status, n) after a batch, or the last one."""
        done = [b for b in self._batches() if batch is None or b <= batch]
        if not done:
            return self.spark.createDataFrame([], "status string, n long")
        return self.spark.read.schema("status string, n long").parquet(f"{self.folder}/batch={done[-1]}")

    def add(self, moved: DataFrame, batch: int, keep: int = 10) -> None:
        sums = moved.groupBy("status").agg(F.sum("change").alias("n"))
        total = self.read(batch - 1).unionByName(sums).groupBy("status").agg(F.sum("n").alias("n")).where("n <> 0")
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")  # a row a status
        for old in self._batches()[:-keep]:
            self.store.remove(f"batch={old}")

    def written_by(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: self.add(rows, n)).option("checkpointLocation", checkpoint)

    def following(self, stream: DataFrame, key: str, status: str, at: str, tie: str, checkpoint: str, buckets: int = 16) -> DataStreamWriter:
        """A writer that moves the gauges by the events of a stream, as changes() does where nothing goes stale, with the last event of each key in a
        keyed table in the folder: a batch groups its events by key and joins them with the buckets kept, and no key is taken alone. Equal events in
        `at` and `tie` leave what holds; in one batch the greatest status of such holds. One stream may follow a folder, always with one checkpoint."""
        names = {"key": key, "at": at, "tie": tie, "status": status}
        rows = stream.where(F.col(key).isNotNull() & F.col(status).isNotNull() & F.col(at).isNotNull()).select(*[F.col(c).alias(n) for n, c in names.items()])
        kept = KeyedTable(self.spark, self.store.path("last"), rows.schema, "key", ("at", "tie"), buckets)

        def batch(events: DataFrame, number: int) -> None:
            if number <= kept.manifest().batches.get("", -1):
                return  # its gauges were written before it was merged
            last = events.groupBy("key").agg(F.max(F.struct("at", "tie", "status")).alias("new"))
            met = last.join(kept.read().select("key", F.struct("at", "tie", "status").alias("old")), "key", "left")
            order = lambda c: F.struct(f"{c}.at", f"{c}.tie")
            newer = met.where(F.col("old").isNull() | (order("new") > order("old"))).persist()
            try:
                ways = [F.struct(F.col(f"{c}.status").alias("status"), F.lit(n).cast("long").alias("change")) for c, n in (("old", -1), ("new", 1))]
                self.add(newer.select(F.inline(F.array(*ways))).where("status IS NOT NULL"), number)
                kept.merge(newer.select("key", "new.*"), number)
            finally:
                newer.unpersist()

        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
