from __future__ import annotations

import random
import re

import numpy as np
import pytest

from claimloom.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in sorted({r[1] for r in rows}):
        docs, counts = {}, {r[2]: {} for r in rows if r[1] == lang}
        for text, of, source in rows:
            terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
            if of == lang:
                for t in terms:
                    t = t.translate(LOW)
                    counts[source][t] = counts[source].get(t, 0) + 1
                for t in {t.translate(LOW) for t in terms}:
                    docs[t] = docs.get(t, 0) + 1
        kept = [t for t, n in docs.items() if n >= min_docs]

        def p(held, kept=kept):
            total = sum(held.get(t, 0) for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (held.get(t, 0) + 1) // total for t in kept}

        def f(a, b):
            return (a - b) ** 2 // b

        by = {s: p(held) for s, held in counts.items()}
        q = p({t: sum(held.get(t, 0) for held in counts.values()) for t in kept})
        for s in by:
            pairs = sorted(((-sum(f(by[s][t], by[o][t]) for t in kept), o.encode(), o) for o in by if o != s))
            terms = sorted((-f(by[s][t], q[t]), t.encode(), t) for t in kept if counts[s].get(t, 0) and by[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def rows(seed=3, n=400, sources=9):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ漢Z") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out = []
    for _ in range(n):
        source = min(int(rng.expovariate(0.4)), sources - 1)
        text = " ".join(words[min(int(rng.expovariate(0.02)) + 3 * source, 299)] for _ in range(rng.randint(0, 40)))
        out.append((text, rng.choice(["en", "de", None]), rng.choice([None, "hot"]) if rng.random() < 0.4 else f"s{source}é"))
    return [*out, ("x1y\nX-y `Z{ÀÉ}" * 3, "en", "hot"), (None, "xx", "only"), ("", "xx", "other"), ("word", "xx", None), ("lone", "yy", "one")]


@pytest.mark.parametrize(("heavy", "tile", "held"), [(0.25, 512, 200_000), (0.0, 512, 50), (2.0, 512, 200_000), (0.5, 4, 30)])
def test_against_all_terms(spark, monkeypatch, heavy, tile, held):
    monkeypatch.setattr(divergence.pair_sums, "__defaults__", (heavy, tile))
    monkeypatch.setattr(divergence, "HELD", held)
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows()], "text string, lang string, source string, `group` int, term string")
    assert got(divergence.source_divergence(docs)) == slow(rows())


def test_top_and_ties(spark):
    data = [("a b c d e f", "en", s) for s in ("one", "two") for _ in range(3)] + [("g h", "en", "one")] * 3
    docs = spark.createDataFrame(data, "text string, lang string, source string")
    assert got(divergence.source_divergence(docs, top=1)) == slow(data, top=1)


def test_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(docs).count() == 0


def test_shares_are_exact_where_products_leave_64_bits():
    rng = random.Random(1)
    totals = [rng.randrange(1, 9 * 10**15) for _ in range(500)]
    counts = [rng.randrange(0, t + 1) for t in totals]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]
