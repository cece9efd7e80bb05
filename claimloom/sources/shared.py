"""The shared folder of a cluster, and small files in whatever store Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on this machine, where nothing is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimloom-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Have whole texts go to Python workers in batches of so many rows at most, for two workers of an executor hold several
    copies of a batch each; a smaller number that the session has stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


class Store:
    """Small files below a folder of any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def names(self, below: str = "") -> list[str]:
        at = self._path(self.path(below) if below else self.folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that is whole or not there; False if there is one of that name already."""
        target, draft = self._path(self.path(name)), self._path(self.path(f"{name}.{uuid.uuid4()}.draft"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.exists(target) and self._fs.rename(draft, target):
            return True
        self._fs.delete(draft, False)
        return False

    def move(self, name: str, to: str) -> bool:
        """Rename a file or folder; False if there is one of that name already."""
        target = self._path(self.path(to))
        self._fs.mkdirs(target.getParent())
        return not self._fs.exists(target) and self._fs.rename(self._path(self.path(name)), target)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)
