from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import language_id, queries

ENGLISH = "the house is on the hill and this was the reason that they came with us for the weather "
FRENCH = "la maison est sur la colline et cette raison était que nous avons pour les vacances une "
RUSSIAN = "дом стоит на холме и это было причиной что они пришли с нами из за погоды "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, t * 5, lang) for k, (t, lang) in enumerate([(ENGLISH, "en"), (FRENCH, "fr"), (RUSSIAN, "ru")] * 4)] + [(90, None, "en"), (91, "x", None)]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, sf).toPandas()
    both = rows.merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(both) == len(rows)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    held = both[both["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert rows["score"].between(0, 1).all()


def test_mixed_text_has_spans(model):
    text = ENGLISH + FRENCH + RUSSIAN
    lang, score, spans = language_id.label_texts([text], model, with_spans=True)[0]
    assert [s[0] for s in spans] == ["en", "fr", "ru"]
    assert spans[0][1] == 0 and sum(s[2] for s in spans) == len(text.replace("-", " ").split())
    assert lang in ("en", "fr", "ru") and 0 < score < 1


def test_script_narrows(model):
    assert language_id.label_texts(["ъъъ щщщ"], model)[0][0] == "ru"
    assert language_id.label_texts(["zzz qqq"], model)[0][0] in ("en", "fr")
    assert language_id.label_texts(["漢字"], model)[0][0] in ("en", "fr", "ru")


def test_edges(spark, model):
    texts = [None, "", "123 !? \n", "the house", "the house", "la maison " * 40_000, "A\ud800b".encode("utf-8", "replace").decode()]
    docs = spark.createDataFrame([(k, t, "x", 2) for k, t in enumerate(texts)], "doc_id long, text string, lang string, found int")
    rows = docs.select("doc_id", language_id.language(F.col("text"), model).alias("f")).orderBy("doc_id").collect()
    assert [r["f"]["lang"] for r in rows[:6]] == ["und", "und", "und", "en", "en", "fr"]
    assert rows[0]["f"]["score"] == 0 and rows[3]["f"] == rows[4]["f"]
    nothing = language_id.train(docs.where("false"))
    assert nothing.languages == () and language_id.label_texts(["the"], nothing)[0][0] == "und"
    assert docs.where("false").select(language_id.language(F.col("text"), model)).count() == 0


def slow_path(scores, switch):
    best, via = [scores[0]], []
    for row in scores[1:]:
        last = best[-1]
        via.append([k if last[k] >= last.max() - switch else int(last.argmax()) for k in range(len(row))])
        best.append(np.maximum(last, last.max() - switch) + row)
    path = [int(best[-1].argmax())]
    for back in reversed(via):
        path.append(back[path[-1]])
    return path[::-1]


def test_many_paths_at_once():
    draw = np.random.default_rng(2)
    lengths = [0, 5, 1, 0, 17, 40, 3]
    scores = draw.normal(scale=2, size=(sum(lengths), 4)).astype(np.float32)
    ends = np.cumsum(lengths)
    path = language_id.best_paths(scores, ends, 3.0)
    for n, end in zip(lengths, ends, strict=True):
        if n:
            total = lambda p, part: sum(part[k, x] for k, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
            part = scores[end - n : end].astype(float)
            assert total(path[end - n : end], part) == pytest.approx(total(slow_path(part, 3.0), part), abs=1e-3)


def test_query_against_plain_viterbi(spark, sf):
    """The query's language of every document by a path sought word by word, with the model fitted again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))

    def slow(text):
        scores, letters, _ = language_id.word_scores([text or ""], model)
        if not len(scores):
            return "und"
        best, back = scores[0].astype(float), []
        for row in scores[1:].astype(float):
            top = int(best.argmax())
            back.append([k if best[k] >= best[top] - language_id.SWITCH else top for k in range(len(best))])
            best = np.maximum(best, best[top] - language_id.SWITCH) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(step[path[-1]])
        held = np.bincount(path[::-1], letters, len(model.languages))
        return model.languages[int(held.argmax())]

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = queries.op9_language_id(spark, sf).collect()
    wrong = [r["doc_id"] for r in found if r["lang_pred"] != slow(texts[r["doc_id"]])]
    assert len(found) == len(texts) and len(wrong) <= len(texts) // 200  # float32 sums may turn a tie


def test_nul_characters_stay_in_their_text(spark, model):
    """U+0000 at both ends and inside a text, in training and prediction, moves no letter to another text."""
    texts = ["\0", "\0\0" + ENGLISH, FRENCH[:40] + "\0" + FRENCH[40:] + "\0", "", RUSSIAN, "\0x\0", ENGLISH]
    alone = [language_id.label_texts([t], model)[0] for t in texts]
    assert language_id.label_texts(texts, model) == alone
    assert [x[0] for x in alone[:5]] == ["und", "en", "fr", "und", "ru"]
    number = language_id.letters_of(texts)[3]
    assert [int((number == k).sum()) for k in range(len(texts))] == [sum(c.isalpha() for c in t.lower()) for t in texts]
    rows = [(k, f"\0{t}\0" * 3 if k % 2 else t * 3, lang) for k, (t, lang) in enumerate([(ENGLISH, "en"), (FRENCH, "fr"), (RUSSIAN, "ru")] * 4)]
    plain = [(k, t.replace("\0", " "), lang) for k, t, lang in rows]
    with_nul, without = (language_id.train(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, plain))
    assert (with_nul.scores == without.scores).all() and (with_nul.allowed == without.allowed).all()
