"""Language ID: scripts narrow the candidates, word scores and a switching penalty label spans by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code point ranges of scripts, first and last; letters outside them share script 1.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
#: Hashed trigrams of a model, and the log odds that a language switch must overcome.
TRIGRAMS, SWITCH = 1 << 16, 12.0
#: Characters whose trigrams are scored at a time, and characters whose paths are sought together.
CHARS, PATH_CHARS = 1 << 19, 1 << 22
UNKNOWN = "und"

_script_table: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Script number of each code point: 0 for what is no letter."""
    if not _script_table:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
        letters = table.astype(bool)
        for k, (_, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                table[a : b + 1][letters[a : b + 1]] = k + 2
        _script_table.append(table)
    return _script_table[0]


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the letters of all texts, in order: trigram bucket, script, whether a word begins, text number.

    A word is a run of letters; trigrams see its ends as one boundary sign. Texts are told apart by their lengths, for they
    may hold any character.
    """
    low = [t.lower() for t in texts]
    joined = "\0".join(["", *low, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_table()[codes]
    sign = np.where(script > 0, codes, np.uint32(32))
    at = np.flatnonzero(script)
    h = sign[at - 1] * np.uint32(0x9E3779B1) ^ sign[at] * np.uint32(0x85EBCA77) ^ sign[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    number = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), at - 1, side="right")
    return (h >> np.uint32(16)).astype(np.int32), script[at], script[at - 1] == 0, number


def chunks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters each; a text is never split."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield begin, k
            begin, held = k, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


@dataclass(frozen=True)
class LanguageModel:
    """Log odds of each trigram bucket and language, and which languages a script can mean."""

    languages: tuple[str, ...]
    scores: np.ndarray  # buckets x languages, float32
    allowed: np.ndarray  # scripts x languages, bool


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bound: int = 8000, min_share: float = 0.05) -> LanguageModel:
    """A model from at most about `bound` documents of each language, chosen by a hash of the text.

    Rows with a null text or language teach nothing; repeated rows are chosen together. Trigrams are counted in
    Spark; the driver gets at most TRIGRAMS sums a language. Without any row the model knows no language.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    limit = F.lit(0)
    for lang in languages:
        limit = F.when(F.col("lang") == lang, int(1_000_000 * min(1, bound / sizes[lang]))).otherwise(limit)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("language"), "text"), F.lit(1_000_000)) < limit)
    names = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(names), TRIGRAMS), np.int64)
        scripts = np.zeros((len(names), len(SCRIPTS) + 2), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([names[x] for x in batch.column(1).to_pylist()])
            for a, b in chunks(texts, CHARS):
                gram, script, _, number = letters_of(texts[a:b])
                lang = langs[a:b][number]
                grams += np.bincount(lang * TRIGRAMS + gram, minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(lang * scripts.shape[1] + script, minlength=scripts.size).reshape(scripts.shape)
        for kind, found in (("gram", grams), ("script", scripts)):
            lang, bucket = np.nonzero(found)
            yield pa.RecordBatch.from_pydict({"kind": [kind] * len(lang), "lang": lang, "bucket": bucket, "n": found[lang, bucket]})

    sums = sample.mapInArrow(count, "kind string, lang long, bucket long, n long").groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((TRIGRAMS, len(languages))), np.zeros((len(SCRIPTS) + 2, len(languages)))
    for kind, into in (("gram", grams), ("script", scripts)):
        some = sums[sums["kind"] == kind]
        into[some["bucket"].to_numpy(np.int64), some["lang"].to_numpy(np.int64)] = some["n"]
    odds = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * TRIGRAMS)) if languages else grams
    odds = odds - odds.mean(1, keepdims=True) if languages else odds
    return LanguageModel(languages, odds.astype(np.float32), scripts >= min_share * np.maximum(scripts.sum(0), 1))


def best_paths(scores: np.ndarray, ends: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi over many texts at once: scores are words x languages, text k ends before word ends[k].

    The texts advance together, a word a step, so that the work of a step is one array operation.
    """
    begins = np.concatenate(([0], ends[:-1]))
    order = np.argsort(begins - ends, kind="stable")
    begins, lengths = begins[order], (ends - begins)[order]
    state, stay = np.zeros((len(order), scores.shape[1]), np.float32), np.ones(scores.shape, bool)
    top = np.zeros(len(scores), np.int16)
    path = np.zeros(len(scores), np.int16)
    live = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")
    for t, n in enumerate(live):
        at, now = begins[:n] + t, state[:n]
        best = now.max(1, keepdims=True)
        if t:
            top[at], stay[at] = now.argmax(1), now >= best - switch
        state[:n] = np.maximum(now, best - switch) - best + scores[at]
    last = np.zeros(len(order), np.int16)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        fresh = slice(live[t + 1] if t + 1 < len(live) else 0, n)
        last[fresh] = state[fresh].argmax(1)
        at = begins[:n] + t
        path[at] = last[:n]
        if t:
            last[:n] = np.where(stay[at, last[:n]], last[:n], top[at])
    return path


def word_scores(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts, in order: log odds of each language, number of letters, number of the text."""
    parts = [(np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in chunks(texts, CHARS):
        gram, script, begins, number = letters_of(texts[a:b])
        if len(gram):
            first = np.flatnonzero(begins)
            scores = np.add.reduceat(model.scores[gram], first, axis=0)
            allowed = model.allowed[script[first]]
            scores[~allowed & allowed.any(1, keepdims=True)] -= 1e4
            parts.append((scores, np.diff(np.append(first, len(gram))), a + number[first]))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def label_texts(texts: list[str | None], model: LanguageModel, switch: float = SWITCH, with_spans: bool = False) -> list[tuple]:
    """(language, score, spans) of each text. The language is that of most letters on the best path; score is the
    letters' mean probability of it, word by word; spans are (language, first word, words)."""
    out: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
    whole = [t or "" for t in texts]
    if not model.languages:
        return out
    for a, b in chunks(whole, PATH_CHARS):
        scores, letters, owner = word_scores(whole[a:b], model)
        if not len(owner):
            continue
        ends = np.searchsorted(owner, np.arange(b - a), side="right")
        path = best_paths(scores, ends, switch)
        odds = np.exp(scores - scores.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        n = len(model.languages)
        held = np.bincount(owner * n + path, letters, (b - a) * n).reshape(b - a, n)
        sure = np.stack([np.bincount(owner, letters * odds[:, k], b - a) for k in range(n)], axis=1)
        for k in np.flatnonzero(held.sum(1)):
            best, spans = int(held[k].argmax()), []
            if with_spans:
                words = path[ends[k - 1] if k else 0 : ends[k]]
                cuts = np.flatnonzero(np.diff(words, prepend=-1))
                spans = [(model.languages[words[c]], int(c), int(d - c)) for c, d in zip(cuts, [*cuts[1:], len(words)], strict=True)]
            out[a + k] = (model.languages[best], float(min(1.0, sure[k, best] / held[k].sum())), spans)
    return out


def language(text: Column, model: LanguageModel, switch: float = SWITCH, with_spans: bool = False) -> Column:
    """struct(lang, score, spans) of a text column; null texts and texts without a letter are `und` with score 0.

    Whole texts are read; spans stay empty unless asked for. Repeated rows and ties (the first language in order
    wins) give equal results.
    """

    @F.pandas_udf("lang string, score double, spans array<struct<lang:string,word:int,words:int>>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = label_texts(list(texts), model, switch, with_spans)
        spans = [[{"lang": x, "word": w, "words": n} for x, w, n in r[2]] for r in rows]
        return pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": spans})

    return udf(text)
