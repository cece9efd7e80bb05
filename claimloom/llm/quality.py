"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.runtime import bounded_share

FEATURES = (
    "log_words", "log_chars", "log_lines", "word_chars", "word_chars_sd", "long_words", "upper", "digits", "symbols", "exclaims", "pipes", "stops",
    "symbol_ends", "all_caps_words", "non_ascii", "distinct_words", "top_word", "repeated_next", "repeated_fours", "repeated_lines", "no_letter_words", "longest_run",
)
#: Most labelled rows that a model is fitted on, chosen by a hash of the id.
FIT_ROWS = 20_000

_WORD_CHARS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_CLASSES = np.zeros((256, 6), np.int64)  # upper, digit, symbol, !, |, sentence stops
for _b in range(256):
    _CLASSES[_b] = (65 <= _b <= 90, 48 <= _b <= 57, 33 <= _b < 127 and _b not in _WORD_CHARS and _b not in b".,'-", _b == 33, _b == 124, _b in b".?")


def statistics(text: str | None) -> tuple[float, ...]:
    """FEATURES of a whole text; null and blank texts give zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    data = text.encode("utf-8", "replace")
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, symbols, exclaims, pipes, stops = (bytes_ @ _CLASSES).tolist()
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    numbers = {w: k for k, w in enumerate(counts)}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    same = ids[1:] == ids[:-1]
    fours = ids[3:] + ids[2:-1] * 1_000_003 + ids[1:-2] * 998_244_353 + ids[:-3] * 2_147_483_647 if n > 3 else ids[:0]
    lines = text.split("\n")
    shown = [x for x in lines if x.strip()]
    ends = Counter(w[-1] for w in words)
    breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    chars = max(1, len(text))
    return (
        float(np.log1p(n)), float(np.log1p(len(text))), float(np.log1p(len(lines))), float(lengths.mean()), float(lengths.std()), float((lengths > 20).mean()),
        upper / chars, digits / chars, symbols / chars, exclaims / chars, pipes / chars, stops / n,
        sum(c for x, c in ends.items() if not x.isalnum() and x not in ".,") / n,
        sum(c for w, c in counts.items() if w.isupper()) / n,
        float(bytes_[128:].sum()) / len(data), len(counts) / n, max(counts.values()) / n, float(same.sum()) / n,
        1 - len(np.unique(fours)) / len(fours) if len(fours) else 0.0, 1 - len(set(shown)) / len(shown),
        sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / n, float(np.diff(breaks).max()) / n,
    )


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; a leaf's children are itself."""

    base: float
    roots: np.ndarray
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Every row goes down every tree at once, a level a step."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        for _ in range(self.depth):
            low = np.take_along_axis(x, self.feature[at], axis=1) <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, smooth: float = 1.0) -> Trees:
    """Boosted trees for the log loss. Splits are chosen on histograms of gradients over quantile bins; ties fall
    to the first feature and the lowest bin. Without rows, or with one class only, the base rate is the score."""
    n, width = x.shape
    ones = (y.sum() + 1) / (n + 2)
    base = float(np.log(ones / (1 - ones)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), np.int64)
    offsets = np.arange(width) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(weight: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(weight)
        return k

    margin = np.full(n, base)
    for _ in range(rounds if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        roots.append(leaf(0.0))
        nodes = [(roots[-1], np.arange(n))]
        for level in range(depth + 1):
            below = []
            for node, rows in nodes:
                g, h = slope[rows].sum(), curve[rows].sum()
                value[node] = rate * g / (h + smooth)
                margin[rows] += value[node] if level == depth else 0
                if level == depth:
                    continue
                flat = (binned[rows] + offsets).ravel()
                gs, hs, cs = (np.bincount(flat, w, width * bins).reshape(width, bins).cumsum(1) for w in (np.repeat(slope[rows], width), np.repeat(curve[rows], width), None))
                gain = gs**2 / (hs + smooth) + (g - gs) ** 2 / (h - hs + smooth) - g**2 / (h + smooth)
                gain[(cs < least) | (len(rows) - cs < least)] = 0
                f, b = divmod(int(gain.argmax()), bins)
                if gain[f, b] <= 1e-9 or b >= len(edges[f]):
                    margin[rows] += value[node]
                    continue
                low = binned[rows, f] <= b
                feature[node], threshold[node] = f, float(edges[f][b])
                left[node], right[node] = leaf(0.0), leaf(0.0)
                below += [(left[node], rows[low]), (right[node], rows[~low])]
            nodes = below
    weights = np.array([0.0 if left[k] != k else v for k, v in enumerate(value)])
    return Trees(base, np.array(roots, np.int64), depth, np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), weights)


def document_statistics(text: Column) -> Column:
    """FEATURES of a text column as array<double>."""

    @F.pandas_udf("array<double>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([list(statistics(t)) for t in texts])

    return udf(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = FIT_ROWS) -> Trees:
    """Trees from at most about `bound` labelled documents, chosen by a hash of the id.

    Labels that are null or without a document teach nothing; of several labels of an id the greatest counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    known = bounded_share(known, id_col, bound)
    rows = docs.select(id_col, text_col).join(F.broadcast(known), id_col)  # at most about `bound` rows of two numbers
    sample = rows.select(document_statistics(F.col(text_col)).alias("x"), F.col("__label").cast("double").alias("y")).toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the result must not hang on the order of rows
    return fit_trees(x[order], sample["y"].to_numpy(float)[order])


def quality_score(text: Column, model: Trees) -> Column:
    """The probability of label 1 for each whole text; null and blank texts have the score of all-zero statistics."""

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(np.concatenate([model.scores(x[k : k + 2048]) for k in range(0, len(x), 2048)]) if len(x) else np.zeros(0))

    return udf(text)
