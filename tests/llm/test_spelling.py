from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:])


def slow_counts(rows, min_chars=7, min_count=2):
    counts: dict = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def slow(rows, pairs=None, **limits):
    counts = slow_counts(rows, **limits)
    out, form = [], {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
        out.append((w, n, len(others)))

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, k, counts[form[w]] if form[w] else None) for w, n, k in out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=7), unique=True, max_size=60), st.integers(0, 2))
def test_trie_against_all_pairs(words, depth):
    depths = np.full(len(words), depth)
    a, b = spelling.near_pairs(words, depths)
    found = sorted(tuple(sorted((words[x], words[y]))) for x, y in zip(a, b, strict=True))
    assert found == sorted((x, y) for x in words for y in words if x < y and near(x, y) and x[:depth] == y[:depth])


def texts(seed=1, n=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("thaengé") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [stems[min(int(rng.expovariate(0.15)), 59)] for _ in range(60)]
        rows.append((i, " ".join(w if rng.random() < 0.9 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k] * 2]) + w[k + 1 :] for w in words)))
    return rows


EDGES = [
    (None, "another another ANOTHER anothers"), (7, None), (7, ""), (8, "short x÷y×éÉéÉ x÷y×éÉéÉ"), (9, "repeated " * 40 + "repeatee repeatee"), (9, "repeated " * 40 + "repeatee repeatee"),
    (10, " ".join(["a" * 300, "a" * 301] * 2)), (11, "Straßenbahn straßenbahn İstanbulda İstanbulda"),
]


@pytest.mark.parametrize(("subtree", "task_words"), [(spelling.SUBTREE, spelling.TASK_WORDS), (20, 16), (2, 8), (1, 3)])
def test_against_all_pairs(spark, monkeypatch, subtree, task_words):
    rows = texts() + EDGES
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, word string, N int, depth int")
    monkeypatch.setattr(spelling.near_words, "__defaults__", (subtree, task_words))
    found = got(spelling.spelling_variants(docs))
    assert found == slow(rows)
    assert any(r[1] for r in found)


def test_long_common_prefix_is_cut_below_it(spark):
    words = ["commonbeginning" + x for x in ("", "a", "b", "ab", "ba", "abc", "abd", "bbd")]
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    found = {r["word"]: r["n_near"] for r in spelling.near_words(frame, 2, 2).collect()}
    assert found == {w: k for w in words if (k := sum(near(w, x) for x in words))}


def test_chain_of_forms_and_ties(spark):
    rows = [(1, " ".join(["mountain"] * 1200 + ["mountaim"] * 110 + ["mountaixm"] * 11 + ["mountais"] * 110))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.spelling_variants(docs)) == slow(rows)


def test_very_long_words(spark):
    rows = [(1, " ".join(["ab" * 20_000, "ab" * 20_000 + "a", "ba" * 20_000 + "b"] * 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.spelling_variants(docs)) == slow(rows)


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_all_pairs(spark, sf):
    source = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = slow_counts(source)
    found = {r["word"]: r for r in queries.op11_spelling_variants(spark, sf).collect()}
    assert {w: r["n"] for w, r in found.items()} == counts
    gaps: dict = {}
    for w in counts:
        for k in range(len(w)):
            gaps.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    for w, n in counts.items():
        others = {x for k in range(len(w)) for x in gaps[k, w[:k] + w[k + 1 :]]} | {s for k in range(len(w)) if (s := w[:k] + w[k + 1 :]) in counts}
        others |= {x for k in range(len(w) + 1) for x in gaps.get((k, w), ())}
        others.discard(w)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 10 * n else None
        assert (found[w]["n_near"], found[w]["form"]) == (len(others), form)
        assert found[w]["root"] == (found[form]["root"] if form else w)
