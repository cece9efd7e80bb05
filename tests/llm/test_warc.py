from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest

from claimloom.llm import warc

ROWS = [
    (5, "http://a.example/5", "x" * 200), (2, "http://a.example/2 b", "x" * 200), (9, None, "x" * 200), (2, "http://a.example/2 b", "x" * 200), (3, "http://b.example/", "short"),
    (4, "http://b.example/4", "short"), (7, "http://c.example/", None), (8, "http://c.example/8", ""), (10, "u", "é\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n" * 10), (11, "v", "é\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n" * 10),
    (12, "w", "long " * 100_000), (None, "n", "x" * 200),
]


def expected(rows):
    first: dict = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = i is not None and first.get(h, i) != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    warc.write(pages, str(tmp_path / "w"), compression=compression)
    back = warc.resolved_records(spark, str(tmp_path / "w"))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect()), key=repr) == expected(ROWS)
    stored = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert bytes(stored[10]["payload"]).decode() == ROWS[8][2] and stored[11]["payload"] is None and stored[9]["payload"] is None
    assert stored[2]["url"] == "http://a.example/2%20b"
    files = [p for p in Path(tmp_path / "w").glob("part-*")]
    records = [r for p in files for r in warc.parse(gzip.open(p).read() if compression == "gzip" else p.read_bytes())]
    assert len(records) == len(ROWS)
    ids = {r["WARC-Record-ID"] for r in records if r["WARC-Type"] == "response"}
    for r in records:
        if r["WARC-Type"] == "revisit":
            assert r["WARC-Refers-To"] in ids and r["WARC-Profile"] == warc.PROFILE and not r["payload"]


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.resolved_records(spark, str(tmp_path / "w")).count() == 0


def test_broken_archive():
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))
