"""A table with one row a key: a batch of changes rewrites the hash buckets that it touches, then a new manifest names them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import StructType

from claimloom.sources.shared import Store


class Conflict(RuntimeError):
    """Another writer has put a manifest of the same version."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each writer
    folders: dict[int, str] = field(default_factory=dict)  # of each bucket that has rows
    buckets: int = 0


class KeyedTable:
    """Rows of `schema` in `folder`, the last of each key in order of the columns `order`; of rows that are equal there, a change wins over what is
    kept. `key` is one column or several. The number of buckets holds from the first batch on.

    A batch that is run again changes nothing, nor do rows that come again: readers see a manifest's files or the next one's, never parts. The
    last `keep` manifests stay readable. One writer at a time may commit; a second one gets a Conflict and may try again. Work on a batch
    grows with the buckets that it touches, so there should be as many as make each a few hundred MB."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: str | tuple[str, ...], order: tuple[str, ...], buckets: int = 64, keep: int = 3) -> None:
        self.spark, self.order, self.keep = spark, order, keep
        self.key = (key,) if isinstance(key, str) else key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.store = Store(spark, folder)
        self._buckets = buckets

    def manifest(self, version: str | None = None) -> Manifest:
        """The latest manifest, or that of a name."""
        names = [version] if version else [n for n in self.store.names("manifests") if n.endswith(".json")]
        if not names:
            return Manifest(buckets=self._buckets)
        found = json.loads(self.store.text(f"manifests/{names[-1]}"))
        return Manifest(found["version"], found["batches"], {int(b): f for b, f in found["folders"].items()}, found["buckets"])

    @staticmethod
    def bucket(key: list[Column], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def _rows(self, manifest: Manifest, only: set[int] | None = None) -> DataFrame:
        folders = [self.store.path(f) for b, f in sorted(manifest.folders.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def lookup(self, *key) -> DataFrame:
        """The row of a key, from its bucket alone."""
        now = self.manifest()
        kinds = [self.schema[k].dataType for k in self.key]
        values = [F.lit(v).cast(t) for v, t in zip(key, kinds, strict=True)]
        number = self.spark.range(1).select(self.bucket(values, now.buckets)).first()[0]
        found = self._rows(now, {number})
        for name, value in zip(self.key, values, strict=True):
            found = found.where(F.col(name) == value)
        return found

    def merge(self, changes: DataFrame, batch: int | None = None, writer: str = "") -> Manifest:
        """The table after changes (its columns, others are left out); a batch of a writer that is not beyond its last one is done already. A null key raises."""
        now = self.manifest()
        if batch is not None and batch <= now.batches.get(writer, -1):
            return now
        columns = [F.col(k) for k in self.key]
        changes = changes.select(self.schema.fieldNames()).persist()
        try:
            absent = F.coalesce(*[F.when(c.isNull(), True) for c in columns], F.lit(False))
            touched = {r["b"]: r["absent"] for r in changes.groupBy(self.bucket(columns, now.buckets).alias("b")).agg(F.count_if(absent).alias("absent")).collect()}  # a row a bucket
            if any(touched.values()):
                raise ValueError(f"{sum(touched.values())} rows without {', '.join(self.key)}")
            folders = dict(now.folders)
            if touched:
                rows = self._rows(now, set(touched)).withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
                whole = F.struct(*self.schema.fieldNames())
                last = rows.groupBy(*columns).agg(F.max_by(whole, F.struct(*self.order, "_new")).alias("_row")).select("_row.*")
                made = f"data/{uuid.uuid4()}"
                placed = last.withColumn("_bucket", self.bucket(columns, now.buckets))
                placed.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(self.store.path(made))
                folders |= {b: f"{made}/_bucket={b}" for b in touched}
        finally:
            changes.unpersist()
        after = Manifest(now.version + 1, now.batches | ({writer: batch} if batch is not None else {}), folders, now.buckets)
        if not self.store.put(f"manifests/{after.version:012d}.json", json.dumps(after.__dict__)):
            raise Conflict(f"version {after.version} is there already")
        self._clear()
        return after

    def _clear(self) -> None:
        """Remove manifests but the last `keep`, and the files that none of those names."""
        names = [n for n in self.store.names("manifests") if n.endswith(".json")]
        if len(names) <= self.keep:
            return
        used = {f.split("/")[1] for n in names[-self.keep :] for f in self.manifest(n).folders.values()}
        gone = {f.split("/")[1] for n in names[: -self.keep] for f in self.manifest(n).folders.values()} - used
        for n in gone:
            self.store.remove(f"data/{n}")
        for n in names[: -self.keep]:
            self.store.remove(f"manifests/{n}")

    def written_by(self, stream: DataFrame, checkpoint: str, writer: str = "") -> DataStreamWriter:
        """A writer that merges each batch of a stream."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.merge(rows, n, writer)).option("checkpointLocation", checkpoint)
