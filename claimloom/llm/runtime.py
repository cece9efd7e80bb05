"""What the operators share: cutting lineage, reading tables, the words of a text."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.shared import modest_batches  # noqa: F401

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where nothing is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="claimloom-"))
    return context.getCheckpointDir()


#: glibc's and Arrow's settings under which what a worker frees goes back to the machine: blocks of over 1 MB at once.
LEAN = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark: SparkSession) -> None:
    """Have Python workers give freed memory back, for a job of several stages, whose workers live as long as their executor. Functions made from
    now on have workers of their own with these settings."""
    for name, value in LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_slim(df: DataFrame) -> DataFrame:
    """cut() for rows of a few numbers that a shuffle has made: in at most two files a core, not one a partition."""
    return cut(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism))


class Scratch:
    """A folder in the shared checkpoint folder for tables of one run, written as Parquet, which is smaller than a
    checkpoint; remove() deletes it when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints that no living DataFrame needs, before more are written."""
    for _ in range(2):  # what one collection frees may hold the next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; for ASCII texts that is the quicker lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold_bucket(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that are columns of df already, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_share(df: DataFrame, key: str, bound: int, among: DataFrame | None = None) -> DataFrame:
    """Rows of df kept by a hash of key so that about `bound` remain; all rows if there are no more."""
    n = (df if among is None else among).count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def join_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, hot_keys: int = 1000) -> DataFrame:
    """rows joined with keyed, which has each key once and in `count` how many rows have it.

    A key with over a thousandth of all counted rows would make one task long. There are at most hot_keys such keys,
    and only those are broadcast; the others meet by a shuffle.
    """
    keyed = cut_slim(keyed)
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total // hot_keys
    few = F.broadcast(keyed.where(hot))
    apart = rows.join(few.select(*keys), keys, "left_anti").join(keyed.where(~hot), keys)
    return rows.join(few, keys).unionByName(apart)
