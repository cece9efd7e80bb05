"""A queue of ids in a shared folder, read as a stream with offsets, whose depth is what has come less what is done."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from claimloom.operators.numbering import numbered
from claimloom.sources.shared import Store

NAME = "claim_queue"
DONE = "done"


def _store(uri: str):
    """pyarrow's file system and path of a folder, which Python workers read without a session."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "/", 1))


def _segments(uri: str) -> list[tuple[int, int, str]]:
    """(first offset, offset after the last, folder) of what has been put in, in order."""
    from pyarrow import fs

    files, path = _store(uri)
    found = files.get_file_info(fs.FileSelector(f"{path}/segments", allow_not_found=True))
    spans = sorted((*map(int, x.base_name.split("-")), x.path) for x in found if x.type == fs.FileType.Directory)
    return [(a, a + n, p) for a, n, p in spans]


class File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class QueueReader(DataSourceStreamReader):
    """Offsets count rows; a batch takes whole segments, `maxSegments` of them at most if that is set."""

    def __init__(self, uri: str, consumer: str, most: int) -> None:
        self.uri, self.consumer, self.most = uri, consumer, most
        self.at = 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        ends = [b for a, b, _ in _segments(self.uri) if a >= self.at]
        ends = ends[: self.most] if self.most else ends
        self.at = ends[-1] if ends else self.at
        return {"rows": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        files, _ = _store(self.uri)
        self.at = max(self.at, end["rows"])
        inside = [p for a, b, p in _segments(self.uri) if start["rows"] <= a and b <= end["rows"]]
        return [File(x.path) for p in inside for x in files.get_file_info(fs.FileSelector(p)) if x.base_name.startswith("part-") and x.size]

    def read(self, partition: File) -> Iterator[tuple]:
        files, _ = _store(self.uri)
        with files.open_input_stream(partition.path) as stream:
            for line in stream.read().decode().splitlines():
                try:
                    row = json.loads(line)
                    yield (int(row["offset"]), int(row["id"]))
                except (ValueError, TypeError, KeyError):  # what is no id is passed over
                    continue

    def commit(self, end: dict) -> None:
        files, path = _store(self.uri)
        files.create_dir(f"{path}/{DONE}")
        draft = f"{path}/{DONE}/.{self.consumer}-{uuid.uuid4()}"
        with files.open_output_stream(draft) as out:
            out.write(str(end["rows"]).encode())
        files.move(draft, f"{path}/{DONE}/{self.consumer}")

    def stop(self) -> None:
        pass


class QueueSource(DataSource):
    """Options: path, consumer and maxSegments."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "`offset` long, id long"

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"], self.options.get("consumer", "worker"), int(self.options.get("maxSegments", 0)))


class Queue:
    """A queue in a folder of the shared store. One writer at a time puts rows in; any number of consumers read, each with its own place."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.store = spark, folder, Store(spark, folder)

    def put(self, ids: DataFrame) -> int:
        """Put the rows of a column id in, in its order; they can be seen all at once. The offset after them."""
        first = self.latest()
        rows = numbered(ids.select(F.col("id").cast("string").alias("id")), "id", name="offset", start=first)
        n = rows.count()
        if n:
            draft = f"drafts/{uuid.uuid4()}"
            rows.select("offset", "id").write.json(self.store.path(draft))
            if not self.store.move(draft, f"segments/{first:015d}-{n:012d}"):
                raise RuntimeError("another writer has put rows in")
        return first + n

    def latest(self) -> int:
        return max((a + n for a, n in (map(int, x.split("-")) for x in self.store.names("segments"))), default=0)

    def done(self, consumer: str = "worker") -> int:
        return int(self.store.text(f"{DONE}/{consumer}")) if consumer in self.store.names(DONE) else 0

    def depth(self, consumer: str = "worker") -> int:
        """Rows that a consumer has not done: it is told of a batch's end when the next one begins, or by settle()."""
        return self.latest() - self.done(consumer)

    def settle(self, checkpoint: str, consumer: str = "worker") -> int:
        """Take over the offset of the last batch that a stream with this checkpoint has finished, for a stream that ends
        tells of it only when it starts again. The depth that is left."""
        store = Store(self.spark, checkpoint)
        finished = [int(n) for n in store.names("commits") if n.isdigit()]
        if finished:
            offset = json.loads(store.text(f"offsets/{max(finished)}").strip().split("\n")[2])["rows"]
            self.store.remove(f"{DONE}/{consumer}")
            self.store.put(f"{DONE}/{consumer}", str(offset))
        return self.depth(consumer)

    def stream(self, consumer: str = "worker", segments: int = 0) -> DataFrame:
        """(offset, id) as they come; what is no whole number is passed over."""
        self.spark.dataSource.register(QueueSource)
        return self.spark.readStream.format(NAME).option("path", self.folder).option("consumer", consumer).option("maxSegments", str(segments)).load()
