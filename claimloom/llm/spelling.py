"""Spelling variants: a trie of the vocabulary, cut at prefixes that Spark deals out, joined with itself by active nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.runtime import ascii_lower, cut, cut_slim

#: The letters of a run, and one run in so many from which the contract has a code point deleted.
LETTERS, DELETED = r"A-Za-zÀ-ÿ", 31
#: Words below a node of the trie above which the trie is cut there, words of a task, and prefix lengths counted at a time.
SUBTREE, TASK_WORDS, DEPTHS = 1 << 14, 1 << 13, 8
LINKS = "word string, n_near long, less long, best string"


def runs_of(text: Column, least: int) -> Column:
    """Maximal runs of letters of at least so many code points, A-Z lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)), ascii_lower)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): the runs of all texts, with a code point deleted from those that the crc32 of `<id>:<run>` picks."""
    run = F.col("run")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs_of(F.col(text_col), min_chars)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    word = F.when(h % DELETED == 0, shorter).otherwise(run)
    return rows.select(word.alias("word")).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _prefix(length: Column | int) -> Column:
    return F.substring("word", F.lit(1), F.lit(length) if isinstance(length, int) else length)


def cut_prefixes(words: DataFrame, subtree: int) -> set[str]:
    """The prefixes of the nodes where the trie is cut: those with over `subtree` words below, so at most words / subtree a level."""
    found: set[str] = set()
    first, levels = 0, DEPTHS
    while True:
        lengths = F.sequence(F.lit(first), F.least(F.char_length("word"), F.lit(first + levels - 1)))
        prefixes = words.where(F.char_length("word") >= first).select(F.explode(F.transform(lengths, _prefix)).alias("prefix"))
        found |= {r["prefix"] for r in prefixes.groupBy("prefix").count().where(F.col("count") > subtree).select("prefix").collect()}
        last = [p for p in found if len(p) == first + levels - 1]
        if not last:
            return found
        first += levels
        levels *= 2
        above = words.sparkSession.createDataFrame([(p,) for p in last], "_above string")
        words = words.join(F.broadcast(above), _prefix(first - 1) == F.col("_above"), "left_semi")  # at most words / subtree


def depth(word: Column, cuts: set[str]) -> Column:
    """The length of a word's first prefix that is not cut, one more than its own length if it is cut itself."""

    @F.pandas_udf("int")
    def udf(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            d = 0
            while d <= len(w) and w[:d] in cuts:
                d += 1
            out.append(d)
        return pd.Series(out, dtype="int32")

    return udf(word) if cuts else F.lit(0)


class Forest:
    """A trie below each of some roots, level by level: the nodes of a level are numbered in the order of (node above, letter)."""

    def __init__(self, words: list[str], depths: np.ndarray) -> None:
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.begins, self.lengths = np.cumsum(lengths) - lengths + depths, np.maximum(lengths - depths, 0)
        self.node = np.unique([w[:d] for w, d in zip(words, depths, strict=True)], return_inverse=True)[1]
        self.alive = np.arange(len(words))
        self.size = int(self.node.max(initial=-1)) + 1
        self.level = 0

    def ends(self) -> np.ndarray:
        """The word that ends at each node of this level, or -1."""
        out = np.full(self.size, -1)
        done = self.lengths[self.alive] == self.level
        out[self.node[done]] = self.alive[done]
        return out

    def descend(self) -> np.ndarray:
        """Go down a level; the sorted keys (node above << 21 | letter) of its nodes."""
        going = self.lengths[self.alive] > self.level
        self.alive, above = self.alive[going], self.node[going]
        keys, self.node = np.unique(above << 21 | self.codes[self.begins[self.alive] + self.level], return_inverse=True)
        self.level, self.size = self.level + 1, len(keys)
        return keys


def _spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of the range of each element, and the elements."""
    sizes = ends - begins
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)


def _below(nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _spread(np.searchsorted(keys, nodes << 21), np.searchsorted(keys, nodes + 1 << 21))


def _both_below(u: np.ndarray, v: np.ndarray, of_u: np.ndarray, of_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of active pairs that go on by the same letter."""
    owner, child = _below(u, of_u)
    wanted = v[owner] << 21 | of_u[child] & (1 << 21) - 1
    at = np.minimum(np.searchsorted(of_v, wanted), max(len(of_v) - 1, 0))
    same = of_v[at] == wanted if len(of_v) else np.zeros(len(wanted), bool)
    return child[same], at[same]


def near_pairs(words: list[str], depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at distance one, below the same prefix of depths[k] code points; words are distinct.

    A node's active set holds itself at distance zero and, at distance one, nodes of its level (`level`) and of the next
    (`longer`); nodes of the level above are the same pairs seen from the other side. From a node itself come its letters
    exchanged (pairs of siblings) and inserted (a node and its child); what has distance one goes on by equal letters."""
    forest = Forest(words, depths)
    none = np.zeros(0, np.int64)
    level, longer, found = (none, none), (none, none), []
    ends, of_root = forest.ends(), np.arange(forest.size)
    keys = forest.descend()
    owner, child = _below(of_root, keys)
    longer = (of_root[owner], child)
    while len(keys):
        next_ends = forest.ends()
        u, v = longer
        found.append((ends[u], next_ends[v]))
        next_keys = forest.descend()
        u, v = _both_below(*level, keys, keys)
        nodes = np.arange(len(keys))
        owner, sibling = _spread(nodes + 1, np.searchsorted(keys, (keys >> 21) + 1 << 21))
        level = (np.concatenate((u, owner)), np.concatenate((v, sibling)))
        found.append((next_ends[level[0]], next_ends[level[1]]))
        u, v = _both_below(*longer, keys, next_keys)
        owner, child = _below(nodes, next_keys)
        pairs = np.unique(np.concatenate((u, owner)) * max(len(next_keys), 1) + np.concatenate((v, child)))
        longer = (pairs // max(len(next_keys), 1), pairs % max(len(next_keys), 1))
        ends, keys = next_ends, next_keys
    a, b = (np.concatenate(x) if x else none for x in zip(*found, strict=True)) if found else (none, none)
    both = (a >= 0) & (b >= 0)
    return a[both], b[both]


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """How many near words each word has within a task, and the commonest, the first in order of equal ones."""
    rows = rows.sort_values("word", ignore_index=True)
    words, n = rows["word"].tolist(), rows["n"].to_numpy(np.int64)
    a, b = near_pairs(words, rows["depth"].to_numpy(np.int64))
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((b, -n[b], a))  # Python orders strings by code point
    a, b = a[order], b[order]
    of, first, count = np.unique(a, return_index=True, return_counts=True)
    names = rows["word"].to_numpy(object)
    return pd.DataFrame({"word": names[of], "n_near": count, "less": -n[b[first]], "best": names[b[first]]})


def _within(words: DataFrame, task_words: int) -> DataFrame:
    """Links below uncut prefixes. Whole subtrees of at most SUBTREE words meet in a task with about TASK_WORDS more."""
    tasks = max(1, words.count() // task_words)
    task = F.pmod(F.xxhash64(_prefix(F.col("depth"))), F.lit(tasks)).cast("int")
    return words.withColumn("task", task).groupBy("task").applyInPandas(_links, LINKS).select("word", "n_near", F.struct("less", F.col("best").alias("word")).alias("best"))


def _across(words: DataFrame) -> DataFrame:
    """Links of words that part at a cut node, whose prefix has k code points: their active nodes have used up the distance
    there, and what is left must be equal. So the words without the code point after the prefix (k of them a word, the depths
    of its cuts) meet each other, and the words as they are. A group has at most two rows a letter and cut."""
    cuts = F.filter(F.sequence(F.lit(0), F.col("depth")), lambda k: (k < F.col("depth")) & (k < F.char_length("word")))
    left = words.where("depth > 0").select("word", "n", F.explode(cuts).alias("k"))
    rest = F.concat(_prefix(F.col("k")), F.substring("word", F.col("k") + 2, F.char_length("word")))
    left = left.select(rest.alias("rest"), "k", "word", "n")
    whole = words.where("depth > 0").select(F.col("word").alias("rest"), F.lit(-1).alias("k"), "word", "n")
    held = left.unionByName(whole).groupBy("rest").agg(F.collect_list(F.struct("k", "word", "n")).alias("held")).where(F.size("held") > 1)
    pairs = held.select("held", F.explode("held").alias("a")).select("a", F.explode("held").alias("b"))
    letter = lambda x, k: F.substring(F.col(f"{x}.word"), k + 1, F.lit(1))
    k = F.greatest("a.k", "b.k")
    met = ((F.col("a.k") == F.col("b.k")) | (F.least("a.k", "b.k") == -1)) & (k >= 0) & (letter("a", k) != letter("b", k))
    best = F.struct((-F.col("b.n")).alias("less"), F.col("b.word").alias("word"))
    return pairs.where(met).select(F.col("a.word").alias("word"), F.lit(1).cast("long").alias("n_near"), best.alias("best"))


def near_words(words: DataFrame, subtree: int = SUBTREE, task_words: int = TASK_WORDS) -> DataFrame:
    """(word, n_near, best): of each of the distinct words (word, n) that has a near one, how many there are and which has the largest n."""
    words = cut_slim(words.withColumn("depth", depth(F.col("word"), cut_prefixes(words, subtree))))
    links = _within(words, task_words).unionByName(_across(words))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where their forms end, by doubling of the steps. A form is so many times
    as frequent that there are few steps."""
    now = cut_slim(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = cut_slim(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = following.select("word", "root")
        if following.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are at least min_chars code points long and occur min_count times; near words differ by one inserted, deleted or replaced code
    point, and a word's form is the commonest near word if it occurs `times` as often. Null and empty texts have no words,
    a null id counts as empty text, repeated rows count again, other columns are not looked at, and an empty table gives no
    rows. Words may be of any length; a tie falls to the first in code-point order."""
    words = cut(word_counts(docs, id_col, text_col, min_chars, min_count))
    found = words.join(near_words(words), "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = cut(found)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
