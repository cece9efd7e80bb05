from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash

from claimloom.llm import paragraphs, queries, sets
from claimloom.llm.paragraphs import _BASE, LEAST_RUN, LONGEST, NEAR


def slow_hash(words):
    x = sum(xxhash.xxh64_intdigest(w, 3) * _BASE**k for k, w in enumerate(words)) % (1 << 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % (1 << 64)
    return x ^ x >> 31


def slow_cuts(words):
    """(first, words) of each paragraph of a text, word by word."""
    pairs = [slow_hash(words[k : k + 2]) for k in range(len(words) - 1)]
    cuts = [0]
    for k, h in enumerate(pairs):
        if k and all(h < x for x in pairs[max(0, k - NEAR) : k]) and all(h <= x for x in pairs[k : k + NEAR + 1]):
            cuts.append(k)
    cuts = sorted({c for a, b in zip(cuts, [*cuts[1:], len(words)]) for c in range(a, max(b, a + 1), LONGEST)})
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(words)]) if b - a >= 5]


def slow(rows, similarity=0.8):
    texts = {(i, t) for i, t in rows if t is not None and i is not None}
    found = sorted({(i, a, n, tuple(w[a : a + n])) for i, t in texts for w in [paragraphs.words_of(t)] for a, n in slow_cuts(w)})
    kinds = sorted({x[3] for x in found})
    shingles = [{w[k : k + 5] for k in range(len(w) - 4)} for w in kinds]
    parent = {w: w for w in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for k, s in enumerate(shingles):
        for x in s:
            holders.setdefault(x, []).append(k)
    for a, b in {p for held in holders.values() for p in itertools.combinations(held, 2)}:
        if len(shingles[a] & shingles[b]) >= similarity * len(shingles[a] | shingles[b]):
            x, y = sorted((root(kinds[a]), root(kinds[b])))
            parent[y] = x
    groups: dict = {}
    for i, a, n, w in found:
        groups.setdefault(root(w), []).append((i, a, n))
    repeated = sorted((i, a, n, min(g)[:2], min(g)[0] < i) for g in groups.values() if len({i for i, _, _ in g}) > 1 for i, a, n in g)
    out = []
    for i, a, n, kept, gone in repeated:
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] == a and out[-1][5] == gone:
            out[-1][2] += n
        else:
            out.append([i, a, n, *kept, gone])
    return sorted(tuple(x) for x in out if x[2] >= LEAST_RUN)


def got(df):
    return sorted((r["doc_id"], r["position"], r["words"], r["component"], r["component_position"], r["removed"]) for r in df.collect())


def test_whole_table(spark, sf):
    found = got(queries.op5_substring_dedup(spark, sf))
    want = slow([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert len(set(found) ^ set(want)) <= 0.02 * len(want) and len(want) > 20


def test_passages_wherever_they_stand(spark):
    """Passages of 51 to 80 words inside longer lines, over line ends and at the ends of texts."""
    draw = random.Random(3)
    some = lambda n: [f"w{draw.randrange(9000)}" for _ in range(n)]
    rows, planted = [], []
    for k in range(150):
        passage = some(draw.randint(51, 80))
        lined = " ".join(passage[:7]) + "\n" + " ".join(passage[7:32]) + "\n\n" + " ".join(passage[32:])
        rows.append((3 * k, "\n".join([" ".join(some(9)), lined, " ".join(some(draw.randint(0, 40)))])))
        rows.append((3 * k + 1, " ".join([*some(200 if k % 2 else 0), *passage, *some(200 if k % 3 else 0)]).upper()))
        rows.append((3 * k + 2, " ".join([*some(60), *passage[:12], *some(60)])))  # twelve words are no passage
        planted += [3 * k, 3 * k + 1]
    found = got(paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")))
    held = {r[0] for r in found}
    assert held <= set(planted) and len(held) >= 0.95 * len(planted)
    assert {r[0] for r in found if r[5]} == {i for i in held if i % 3 == 1}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    base = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(300):  # a group of likes larger than a band's pairs, most of them different
        words = list(base)
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(60)] = f"new{draw.randrange(1000)}"
        rows.append((i, "head\n" + " ".join(words)))
    rows += [(1000 + k, " ".join(f"{k}-{j}" for j in range(70))) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "short line"), (None, " ".join(base)), (2003, " ".join(base).upper() + "\n" + " ".join(base)), (2003, " ".join(base).upper() + "\n" + " ".join(base))]
    return rows + [(2004, "same " * 20_000), (2005, "Same " * 200)]


def test_large_group(spark, corpus):
    docs = spark.createDataFrame([(i, t, 1) for i, t in corpus], "doc_id long, text string, words int")
    want, found = slow(corpus), got(paragraphs.repeated_paragraphs(docs))
    assert len(set(found) ^ set(want)) <= 0.02 * len(want)
    cleaned = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeats(docs).collect()}
    assert cleaned[0] == corpus[0][1] and cleaned[299] == "word56 word57 word58 word59" and cleaned[2000] is None and cleaned[2002] == "short line"


def test_empty(spark):
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_agree_with_sets():
    draw = np.random.default_rng(0)
    some = [np.unique(draw.integers(0, 300, draw.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    counts = sets.shared_counts(some, columns=64)
    assert all(counts[a, b] == len(np.intersect1d(some[a], some[b])) for a in range(30) for b in range(30))
    links = draw.random((40, 40)) < 0.03
    links |= links.T
    root = sets.roots_of(links)
    assert all(root[a] == root[b] for a, b in zip(*np.nonzero(links), strict=True)) and (root <= np.arange(40)).all()


def test_recall_of_bands():
    s = paragraphs.SIMILARITY
    assert 1 - (1 - s**paragraphs.ROWS) ** paragraphs.BANDS > 0.98
