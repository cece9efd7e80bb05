"""WARC archives with revisit records: payload digests are resolved by shuffling headers, then archives are written
and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.runtime import cut, join_by_key

#: Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive file, about; a file is read back whole.
FILE_BYTES = 8_000_000
#: Shortest payload that may be a revisit.
LEAST_BYTES = 100

READ = "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: Column, digest: Column) -> Column:
    """A name that reruns give again: a version 8 UUID of the page and its payload."""
    h = F.sha2(F.concat_ws(":", page_id.cast("string"), digest).cast("binary"), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _header(fields: list[tuple[str, Column]]) -> Column:
    """WARC header lines; a field whose value is null is left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v)) for name, v in fields]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2))


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages as page_id, url, html, digest (SHA-256 of the payload) and bytes; null html is an empty payload."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html").cast("long")})


def revisits(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest, first_id and first_url of the payloads' pages that revisit another.

    Of the pages with equal payloads of at least least_bytes, that with the least id is the response and the others
    revisit it; rows that repeat its id are responses too, and so are rows with a null id. Only headers move: ids,
    urls and digests are aggregated by digest before and after the shuffle.
    """
    long = rows.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    first = long.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n")).where("first.page_id < last")
    first = first.select("digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return join_by_key(long.select("page_id", "digest"), first, ["digest"], "n").drop("n").where("page_id > first_id").distinct()


def records(rows: DataFrame, date: str) -> DataFrame:
    """One WARC record a row, in a column value, without the two line ends after it; revisits have a first_id."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("first_id").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20")
    header = _header(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id"), F.col("digest")))),
            ("WARC-Refers-To-Target-URI", F.when(revisit, F.regexp_replace(F.col("first_url"), r"[\x00-\x20]", "%20"))),
            ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
            ("X-Page-ID", F.col("page_id").cast("string")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(block).cast("string")),
        ]
    )
    return rows.select(F.concat(header, block).alias("value"))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", **columns: str) -> None:
    """Write archives of the pages' records into the folder, by Spark's own writer, a file a task of about
    FILE_BYTES. Payloads move once.

    The text writer ends each row with its line separator, here the two line ends that end a record, so a file is
    a WARC file byte for byte (in one gzip stream, or plain with compression none).
    """
    rows = payloads(pages, **columns)
    files = int(1 + (rows.agg(F.sum("bytes")).first()[0] or 0) // FILE_BYTES)
    rows = rows.repartition(files, "page_id", "digest").join(revisits(rows), ["page_id", "digest"], "left")
    records(rows, date).write.option("lineSep", CRLF * 2).option("compression", compression).text(folder)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, by their content lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}: {version[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        begin, end = stop + 4, stop + 4 + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it should")
        http, _, payload = data[begin:end].partition(b"\r\n\r\n")
        yield fields | {"http": http, "payload": payload}
        at = end + 4


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in the folder. A response's bytes and digest are measured on its payload, a
    revisit's come from its headers; payload is null for revisits, or everywhere if not asked for."""
    unzip = re.compile(rb"\x1f\x8b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for data in batch.column(0).to_pylist():
                if unzip.match(data):
                    data = zlib.decompress(data, 47)
                held: list[tuple] = []
                for r in parse(data):
                    own = r["WARC-Type"] == "response"
                    length = re.search(rb"(?i)\r\ncontent-length: (\d+)", r["http"])
                    size = len(r["payload"]) if own else int(length[1]) if length else None
                    digest = hashlib.sha256(r["payload"]).hexdigest() if own else r["WARC-Payload-Digest"].partition(":")[2]
                    page = r.get("X-Page-ID")
                    held.append((int(page) if page else None, r.get("WARC-Target-URI"), r["WARC-Type"], r["WARC-Record-ID"], r.get("WARC-Refers-To"), size, digest, r["payload"] if own and with_payload else None))
                    if len(held) == 500:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(folder).select("content")
    return files.mapInArrow(rows, READ)


def resolved_records(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives hold, a row a record: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    Revisits are joined to the responses that they refer to, whose measured bytes and digest they get.
    """
    found = cut(read(spark, folder, with_payload=False).drop("payload"))
    responses = found.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
    revisits = found.where("record_type = 'revisit'")
    referred = revisits.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    known = referred.join(responses, F.col("refers_to_id") == F.col("record_id"), "left").drop("record_id")
    joined = join_by_key(revisits.drop("payload_bytes", "payload_digest"), known, ["refers_to_id"], "n")
    columns = ("page_id", "url", "record_type")
    own = found.where("record_type = 'response'").select(*columns, "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(joined.select(*columns, F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to"))
