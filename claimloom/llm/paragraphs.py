"""Substring dedup: paragraph MinHash banding, exact Jaccard verification, removals clustered by components.

A paragraph is a stretch of words between two cuts that the words themselves set, over line ends, so that a passage is
cut alike wherever it stands and no words are left out but pieces of under five."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.components import connected_components
from claimloom.llm.runtime import WORD, Scratch, cut, cut_slim, fresh, join_by_key, release
from claimloom.llm.sets import set_similarity, spanning_links

#: At a Jaccard similarity of 0.8, a pair shares one of 4 bands of 2 with probability 1 - (1 - 0.8 ** 2) ** 4 = 0.983.
BANDS, ROWS = 4, 2
#: Words of a shingle, and least similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: A cut stands where a pair of words has the least hash of all pairs within so many words; no paragraph is longer than LONGEST.
NEAR, LONGEST = 5, 64
#: Words of the shortest stretch of repeated paragraphs that counts. Of 51 words that repeat, 11 are lost at each end on average.
LEAST_RUN = 20
#: Words whose hashes are held at a time, but for a longer text.
BLOCK_WORDS = 1 << 16
#: Paragraphs of a band up to which each pair is a row; larger bands are compared in blocks of about so many.
PAIRED, BAND_BLOCK = 16, 256

_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_rng = np.random.default_rng(20_240_101)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_HIGHEST = np.uint64((1 << 64) - 1)


def words_of(text: str) -> list[bytes]:
    """The words compared: split at white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Sums:
    """64-bit hashes of any runs of words, from sums of the words' hashes times powers of an odd number."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        if n >= len(Sums._up):
            Sums._up, Sums._down = _powers(_BASE, 2 * n + 1), _powers(pow(_BASE, -1, 1 << 64), 2 * n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * Sums._up[:n], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * Sums._down[begin]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return x ^ x >> np.uint64(31)


class Texts:
    """The words of some texts in one array, with gaps between texts, and their paragraphs."""

    def __init__(self, texts: list[str]) -> None:
        digest, hashes, self.begins = xxhash.xxh64_intdigest, [], []
        self.ends = []
        for text in texts:
            self.begins.append(len(hashes))
            hashes += [digest(w, 3) for w in words_of(text)]
            self.ends.append(len(hashes))
            hashes += [0] * (NEAR + 2)
        self.words = np.array(hashes, np.uint64)
        self.sums = Sums(self.words)
        at = np.arange(max(0, len(hashes) - SHINGLE + 1))
        self.shingles = self.sums.hashes(at, at + SHINGLE)

    def cuts(self) -> np.ndarray:
        """Where paragraphs begin: at texts, at least pairs of words (of equal ones the first), and so far on that none is too long."""
        at = np.arange(len(self.words) - 1)
        pairs = self.sums.hashes(at, at + 2)
        inside = np.zeros(len(at) + 1, bool)
        for a, b in zip(self.begins, self.ends, strict=True):
            inside[a : max(a, b - 1)] = True
        pairs[~inside[:-1]] = _HIGHEST
        padded = np.concatenate((np.full(NEAR, _HIGHEST), pairs, np.full(NEAR, _HIGHEST)))
        least = np.lib.stride_tricks.sliding_window_view(padded, 2 * NEAR + 1).argmin(1) == NEAR
        found = np.union1d(np.flatnonzero(least & inside[:-1]), np.array(self.begins, np.int64))
        ends = np.append(found[1:], len(self.words))
        long = np.flatnonzero(ends - found > LONGEST)
        return np.union1d(found, np.concatenate([np.arange(found[k], ends[k], LONGEST) for k in long])) if len(long) else found

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, first word in all, and words of each paragraph of at least one shingle."""
        first = self.cuts()
        text = np.searchsorted(np.array(self.begins), first, side="right") - 1
        last = np.minimum(np.append(first[1:], len(self.words)), np.array(self.ends)[text])
        full = last - first >= SHINGLE
        return text[full], first[full], (last - first)[full]

    def bands(self, first: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """The band keys of each paragraph, with the number of the band in the highest bits."""
        spans = np.stack((first, first + words - SHINGLE + 1), axis=1).ravel()
        keys = []
        for band in range(BANDS):
            mixed = np.zeros(len(first), np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                turned = np.append(self.shingles * _MULTIPLY[k] + _ADD[k], _HIGHEST)
                mixed = (mixed ^ np.minimum.reduceat(turned, spans)[::2] >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            keys.append(mixed & np.uint64((1 << 60) - 1) | np.uint64(band << 60))
        return keys


def _in_blocks(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, chars = [], [], 0
    for doc, text in rows:
        ids.append(doc)
        texts.append(text)
        chars += len(text)
        if chars >= 6 * BLOCK_WORDS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def paragraph_table(docs: DataFrame, banded: bool = True) -> DataFrame:
    """doc_id, first, words, h and, if banded, band keys of each paragraph; docs has doc_id and text.

    Paragraphs of under four shingles have no bands: at a similarity of 0.8 and more they are like equal ones only."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("first", pa.int32()), pa.field("words", pa.int32()), pa.field("h", pa.int64())]
    keys = [f"b{k}" for k in range(BANDS)] if banded else []
    schema = pa.schema(fields + [pa.field(k, pa.int64()) for k in keys])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for ids, texts in _in_blocks(pairs):
            held = Texts(texts)
            text, first, words = held.paragraphs()
            if not len(first):
                continue
            short = words < SHINGLE + 3
            bands = [pa.array(b.view(np.int64), mask=short) for b in held.bands(first, words)] if banded else []
            whole = held.sums.hashes(first, first + words).view(np.int64)
            columns = [np.array(ids, np.int64)[text], (first - np.array(held.begins)[text]).astype(np.int32), words.astype(np.int32), whole]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *bands], schema=schema)

    return docs.mapInArrow(split, ", ".join(["doc_id long, first int, words int, h long", *(f"{k} long" for k in keys)]))


def set_table(wanted: DataFrame) -> DataFrame:
    """pid and the sorted hashes of the different shingles of each wanted paragraph (text, paragraphs: pid, h, first, words). A
    text that does not hold a paragraph there, another one with the same id, gives none for it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, bytes]] = []
            for text, paragraphs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = Texts([text])
                for p in paragraphs:
                    end = p["first"] + p["words"]
                    if end <= held.ends[0] and int(held.sums.hashes(np.array([p["first"]]), np.array([end])).view(np.int64)[0]) == p["h"]:
                        rows.append((p["pid"], np.unique(held.shingles[p["first"] : end - SHINGLE + 1]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["pid", "hashes"])

    return wanted.select("text", "paragraphs").mapInArrow(split, "pid long, hashes binary")


def linked_in_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that connect what similarity links within the bands of members (band, n, pid, hashes).

    A band's paragraphs are dealt into blocks of about BAND_BLOCK; every two blocks, and every block with itself, meet
    in one task, and only what joins the task's paragraphs comes out.
    """
    blocks = F.ceil(F.col("n") / BAND_BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("pid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "pid", "hashes")

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        return spanning_links(held, similarity, "pid")

    return dealt.groupBy("band", "low", "high").applyInPandas(compare, "a long, b long")


def repeated_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN, similarity: float = SIMILARITY, broadcast_ids: int = 200_000
) -> DataFrame:
    """One row for each stretch of paragraphs that other documents hold too: doc_id, position, words, component,
    component_position, copies, removed.

    Equal paragraphs (by words, A-Z lower-cased, compared by 64-bit hashes) meet as one. Of the different ones, those
    that share a band are compared by the exact Jaccard similarity of their five-word shingles and linked if it is at least
    `similarity`. Of a component of paragraphs that at least two documents hold, the one in the least document, then place,
    stays, and those in other documents are removed. Neighbouring paragraphs of a document that are all removed or all
    stay make one stretch; those of under least_run words are left out. position is the number of its first word,
    component and component_position say where what stays of its first paragraph stands, and copies how often its most
    frequent paragraph stands anywhere. In bands of over PAIRED paragraphs the comparisons are made in blocks, inside tasks
    of a fixed size, and only what joins components comes out of them; no link is lost.
    Null texts and ids and texts of under five words have no paragraphs, repeated rows count once, rows that repeat an id
    with other texts are one document, an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "paragraphs")
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = paragraph_table(known)
    keys = [f"b{k}" for k in range(BANDS)]
    place = F.min(F.struct("doc_id", "first")).alias("at")
    distinct = found.groupBy("h").agg(place, F.max("doc_id").alias("last"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("words", *keys)))
    distinct = scratch.written(distinct.withColumn("pid", F.monotonically_increasing_id()), "distinct")
    release(spark)
    bands = distinct.select("pid", F.explode(F.array(*keys)).alias("band")).where("band is not null")
    shared = cut_slim(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    release(spark)
    members = cut_slim(join_by_key(bands, shared, ["band"], "n"))
    release(spark)

    needed = distinct.select("pid", "h", "at", "words").join(members.select("pid").distinct(), "pid")
    wanted = cut(needed.groupBy("at.doc_id").agg(F.collect_list(F.struct("pid", "h", "at.first", "words")).alias("paragraphs")))
    texts = known
    if wanted.count() <= broadcast_ids:
        texts = known.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
    sets = cut(set_table(texts.join(wanted, "doc_id")).dropDuplicates(["pid"]))
    release(spark)

    few = members.where(F.col("n") <= PAIRED).select("band", "pid")
    pairs = few.withColumnRenamed("pid", "a").join(few.withColumnRenamed("pid", "b"), "band").where("a < b").select("a", "b").distinct()
    sides = pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
    links = sides.where(set_similarity(F.col("a_set"), F.col("b_set")) >= similarity).select("a", "b")
    many = members.where(F.col("n") > PAIRED).join(sets, "pid")
    roots = connected_components(links.unionByName(linked_in_blocks(many, similarity)), "a", "b")
    release(spark)

    placed = distinct.select("pid", "h", "n", "at", "last").join(roots, F.col("pid") == F.col("node"), "left").where("n > 1 or node is not null")
    placed = cut_slim(placed.select("h", "n", "at", "last", F.coalesce("component", "pid").alias("component")))
    kept = placed.groupBy("component").agg(F.min("at").alias("kept"), F.max("last").alias("end"), F.sum("n").alias("copies"), F.count("*").alias("kinds"))
    named = join_by_key(placed.select("h", "n", "component"), kept.where("kept.doc_id < end").drop("end"), ["component"], "kinds")
    found = scratch.written(paragraph_table(known, banded=False), "found")  # made again, which is less than kept with its bands
    rows = join_by_key(found, named.select("h", "n", "kept", "copies"), ["h"], "n")
    rows = rows.select("doc_id", "first", "words", "kept", "copies", (F.col("kept.doc_id") < F.col("doc_id")).alias("removed")).dropDuplicates(["doc_id", "first", "words"])
    in_order = Window.partitionBy("doc_id").orderBy("first", "words")
    follows = (F.lag(F.col("first") + F.col("words")).over(in_order) == F.col("first")) & (F.lag("removed").over(in_order) == F.col("removed"))
    rows = rows.withColumn("opens", F.when(follows, 0).otherwise(1)).withColumn("stretch", F.sum("opens").over(in_order))
    out = rows.groupBy("doc_id", "stretch", "removed").agg(F.min(F.struct("first", "kept")).alias("x"), F.sum("words").cast("int").alias("words"), F.max("copies").alias("copies"))
    out = out.where(F.col("words") >= least_run)
    out = cut_slim(out.select("doc_id", F.col("x.first").alias("position"), "words", F.col("x.kept.doc_id").alias("component"), F.col("x.kept.first").alias("component_position"), "copies", "removed"))
    scratch.remove()
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with text_col rid of the stretches that repeated_paragraphs marks as removed, each with the white space after it;
    null texts stay null, rows without an id keep theirs."""
    word = re.compile(WORD)

    @F.pandas_udf("string")
    def without(texts: pd.Series, stretches: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, stretches, strict=True):
            if text is not None and gone is not None and len(gone):
                begins = [m.start() for m in word.finditer(text)] + [len(text)]
                ranges = sorted((begins[min(s["position"], len(begins) - 1)], begins[min(s["position"] + s["words"], len(begins) - 1)]) for s in gone)
                text = "".join(text[a:b] for a, b in zip([0, *(b for _, b in ranges)], [*(a for a, _ in ranges), len(text)], strict=True))
            out.append(text)
        return pd.Series(out, dtype=object)

    marked = repeated_paragraphs(docs, id_col, text_col, **how).where("removed")
    of, ranges = fresh(docs, "of", "gone")
    gone = marked.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("position", "words")).alias(ranges))
    joined = docs.join(gone, F.col(id_col) == F.col(of), "left")
    return joined.select(*[without(F.col(c), F.col(ranges)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
