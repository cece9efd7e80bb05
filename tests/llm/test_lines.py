from __future__ import annotations

import hashlib

import pytest

from claimloom.llm import line_dedup, oracles, queries
from tests.oracle import assert_same, connect


def slow(rows, min_chars=10, min_docs=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and min(held[key(x)]) != i)]
        out.append((-1 if i is None else i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


ROWS = [
    (3, "Hello there world\nshort\nunique line of three"),
    (1, "  HELLO there world \r\nshort\n"),
    (2, "hello there world\nhello there world\nÄhnlich LANGE Zeile"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (7, "ähnlich lange zeile\nÄhnlich lange Zeile"),
    (7, "ähnlich lange zeile\nÄhnlich lange Zeile"),
    (8, "\n".join(["the very same line"] * 3000 + [f"line number {k}" for k in range(3000)])),
    (9, "the very same line\nline number 77"),
    (None, "hello there world"),
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_cases(spark, min_docs):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in ROWS], "doc_id long, text string, _id string, n_lines int")
    found = line_dedup.drop_repeated_lines(docs, min_docs=min_docs)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect())
    assert got == slow(ROWS, min_docs=min_docs)
    assert found.columns == ["doc_id", "text", "_id", "n_lines", "n_dropped"]


def test_empty(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_against_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).sql(oracles.ORACLES[name]).df())


def test_query_digest(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, sf).collect()}
    source = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, text, n, dropped in slow(source):
        assert (rows[i]["n_lines"], rows[i]["n_dropped"], rows[i]["kept_sha256"]) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


def test_one_id_with_different_texts_and_clashing_columns(spark):
    rows = [(1, "a shared line of text\nonly here, in row one", 1, 1, "x"), (2, "first of the second\nA shared line of text ", 2, 2, "y"), (2, "a shared line of text\nother row of the second", 3, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_id int, line_gone int, LINE_PARTS string")
    found = line_dedup.drop_repeated_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["line_id"], r["text"]) for r in found.collect()) == [(1, 1, rows[0][1]), (2, 2, "first of the second"), (2, 3, "other row of the second")]
