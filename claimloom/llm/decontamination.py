"""Benchmark decontamination: pigeonhole pieces found exactly, verified by Myers' bit-parallel distance."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.runtime import cut, fresh

WORDS = re.compile(r"[^\W_]+")
#: Share of an item's words that may differ.
ERRORS = 0.2
#: Characters of items that the driver holds and sends to the tasks at a time; more items go in further passes over the
#: documents, each a job of its own.
BLOCK_CHARS = 8_000_000

HITS = "array<struct<item_id:long,distance:int,begin_word:int,end_word:int>>"


def normal_words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def error_budget(n: int, errors: float = ERRORS) -> int:
    """Edits that an item of n words may have."""
    return int(errors * n)


def pieces(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """errors + 1 pieces of even length with their offsets: one of them stays whole under that many edits."""
    cuts = [k * len(words) // (errors + 1) for k in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of the text, end of the first such stretch), in words."""
    n = len(pattern)
    full, high = (1 << n) - 1, 1 << (n - 1)
    masks: dict[str, int] = {}
    for k, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << k
    plus, minus, score = full, 0, n
    best, end = n, 0
    for k, word in enumerate(text):
        same = masks.get(word, 0)
        vertical = same | minus
        across = ((same & plus) + plus ^ plus) | same
        up, down = minus | ~(across | plus) & full, plus & across
        score += bool(up & high) - bool(down & high)
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score < best:
            best, end = score, k + 1
    return best, end


class Matcher:
    """Finds the items of a block in texts. Different texts with one id are told apart by number."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float = ERRORS) -> None:
        self.items, found = {}, {}
        self.ids = [item for item, _ in items]
        for item, (_, text) in enumerate(items):
            words = normal_words(text)
            budget = error_budget(len(words), errors)
            self.items[item] = (words, budget)
            for offset, piece in pieces(words, budget) if words else ():
                found.setdefault(f" {' '.join(piece)} ", []).append((item, offset, len(piece)))
        self.pieces = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.pieces.add_word(piece, (len(piece), uses))
        if found:
            self.pieces.make_automaton()
        self.any = bool(found)

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, word after the last) of each item that the text holds, once an item."""
        words = normal_words(text)
        if not words or not self.any:
            return []
        joined, least = f" {' '.join(words)} ", {}
        begins: list[int] = []
        tried, best = set(), {}
        for end, (length, uses) in self.pieces.iter(joined):
            if not begins:
                begins = list(accumulate((len(w) + 1 for w in words), initial=1))
            word = bisect_right(begins, end - length + 2) - 1
            for item, offset, _ in uses:
                if (item, word - offset) in tried or item in best and best[item][0] == 0:
                    continue
                tried.add((item, word - offset))
                pattern, errors = self.items[item]
                a = max(0, word - offset - errors)
                window = words[a : word - offset + len(pattern) + errors]
                distance, stop = myers(pattern, window)
                if distance <= errors and (item not in best or distance < best[item][0]):
                    _, length = myers(pattern[::-1], window[:stop][::-1])
                    best[item] = (distance, a + stop - length, a + stop)
        for item, found in best.items():
            held = least.get(self.ids[item])
            least[self.ids[item]] = found if held is None else min(held, found)
        return [(item, *found) for item, found in least.items()]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", unnamed: bool = False) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, each collected when it is asked for; those of one id are in one
    block, null texts are no items, null ids only if unnamed. There is one block at least."""
    items = benchmark.where((F.col(id_col).isNotNull() | F.lit(unnamed)) & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = 1 + (items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_CHARS
    number = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(n))
    for k in range(n):
        yield [(r["id"], r["text"]) for r in items.where(number == k).collect()]


def matches(text: Column, block: list[tuple[int | None, str]], errors: float = ERRORS) -> Column:
    """The items of a block that a text holds, as an array of struct(item_id, distance, begin_word, end_word).

    An item counts as held if a stretch of the text's words is within a share `errors` of the item's words by edit distance;
    words are runs of letters and digits, lower-cased. An item too short for an error must stand there word for word;
    an item without words is held by nothing. Null and blank texts hold nothing. Each item comes once a text
    with its least distance found.
    """

    @F.pandas_udf(HITS)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block, errors)
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "begin_word", "end_word"), h, strict=True)) for h in matcher.hits(t)] for t in texts])

    return udf(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: float = ERRORS) -> DataFrame:
    """One row for each document and benchmark item it holds: id, item_id, distance, begin_word, end_word.

    Items are held as matches() says; items without an id are left out, for they could not be named. Repeated rows of
    docs give repeated rows, a row without an id one with a null id; other columns are not read; an empty table on
    either side gives none. Where there are several blocks of items, each is a pass whose hits are written.
    """
    passes: list[DataFrame] = []
    for block in item_blocks(benchmark):
        if passes:
            passes[-1] = cut(passes[-1])
        passes.append(docs.select(F.col(id_col), matches(F.col(text_col), block, errors).alias("hits")).select(id_col, F.inline("hits")))
    return reduce(DataFrame.unionByName, passes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", errors: float = ERRORS) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, as they are: repeated rows stay, all columns too, rows with a
    null text stay; items without an id count. Where there are several blocks of items, each is a pass over what the
    last one left, which is written."""
    (hits,) = fresh(docs, "hits")
    now, first = docs, True
    for block in item_blocks(benchmark, unnamed=True):
        now = (now if first else cut(now)).withColumn(hits, matches(F.col(text_col), block, errors)).where(F.size(hits) == 0).select(docs.columns)
        first = False
    return now
