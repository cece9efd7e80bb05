from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import decontamination as d


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=80), st.lists(st.sampled_from("abc"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_myers(pattern, text):
    assert d.myers(pattern, text) == slow_distance(pattern, text)


def slow_hits(items, text):
    words = d.normal_words(text)
    out = []
    for item, t in items:
        p = d.normal_words(t)
        if not p:
            continue
        if words and slow_distance(p, words)[0] <= d.error_budget(len(p)):
            out.append(item)
    return sorted(out)


def test_against_all_alignments():
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(1, 40)))) for k in range(40)]
    matcher = d.Matcher(items)
    for _ in range(400):
        words = draw.choices(vocabulary, k=draw.randint(0, 60))
        _, source = draw.choice(items)
        leak = source.split()
        for _ in range(draw.randint(0, max(1, len(leak) // 4))):
            k = draw.randrange(len(leak))
            leak[k : k + 1] = draw.choice(([], ["xx"], [leak[k], "yy"]))
            if not leak:
                break
        at = draw.randint(0, len(words))
        text = " ".join([*words[:at], *leak, *words[at:]]).upper().replace(" ", ", ")
        hits = matcher.hits(text)
        assert sorted(h[0] for h in hits) == slow_hits(items, text)
        for item, distance, begin, end in hits:
            p, w = d.normal_words(dict(items)[item]), d.normal_words(text)
            assert slow_distance(p, w[begin:end])[0] == distance


def test_whole_table(spark, sf):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    items += [(1000 + i, " ".join("zz" if k % 9 == 4 else w for k, w in enumerate(t.split()))) for i, t in items]  # held with edits
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(docs, benchmark).collect())
    texts = {r["doc_id"]: d.normal_words(r["text"]) for r in docs.collect()}
    least = {(doc, i): d.myers(p, words)[0] for i, t in items if (p := d.normal_words(t)) for doc, words in texts.items()}
    want = {(doc, i): n for (doc, i), n in least.items() if n <= 0.2 * len(d.normal_words(dict(items)[i]))}
    assert found == sorted(want) and 0 < sum(n > 0 for n in want.values())
    clean = d.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()} == {i for i, _ in found}


def test_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "yes", 0), (3, "yes", 0), (4, "yes no", 0), (5, "x " * 40_000 + "a b c d e f g h", 0)], "doc_id long, text string, _hits int")
    benchmark = spark.createDataFrame([(1, "Yes!"), (2, None), (None, "yes"), (3, "a b c D e f g h"), (3, "a b c D e f g h")], "item_id long, text string")
    rows = lambda b: sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(docs, b).collect())
    want = rows(benchmark.distinct())
    assert want == [(3, 1), (3, 1), (4, 1), (5, 3)]
    monkeypatch.setattr(d, "BLOCK_CHARS", 10)  # the same in several blocks
    assert rows(benchmark.distinct()) == want
    assert rows(benchmark.where("false")) == []
    assert d.contaminated(docs.where("false"), benchmark).count() == 0


def test_shared_and_missing_ids(spark):
    texts = [" ".join(f"{k}q{j}" for j in range(20)) for k in range(4)]
    benchmark = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(texts)], "doc_id long, text string")
    found = d.contaminated(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["begin_word"], r["end_word"]) for r in found) == [(0, 1, 0, 1, 21), (1, 1, 0, 1, 21)]
    assert [r["doc_id"] for r in d.decontaminate(docs, benchmark).collect()] == [3]


def test_short_items_are_found_in_texts(spark):
    """Items of one to nine words: word for word below five words, one edit from there on."""
    for n in range(1, 10):
        item = " ".join(f"q{k}" for k in range(n))
        edited = item.replace("q0", "zz")
        docs = spark.createDataFrame([(1, f"what {item} then"), (2, f"what {edited} then"), (3, "nothing of it")], "doc_id long, text string")
        found = {r["doc_id"]: r["distance"] for r in d.contaminated(docs, spark.createDataFrame([(n, item)], "item_id long, text string")).collect()}
        assert found == ({1: 0} if n < 5 else {1: 0, 2: 1})
    assert d.Matcher([(1, "a b c d e f g h i j")], errors=0.0).hits("a b c d e f g h i zz") == []
