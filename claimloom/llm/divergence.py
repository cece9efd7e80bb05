"""Divergence of the sources of a language: exact sums over all kept terms, dense for terms of many groups, sparse for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.runtime import cut

#: Terms in lower-cased UTF-8: runs of ASCII letters and of all code points beyond ASCII. Lower-casing bytes leaves those as they are.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: The whole of a distribution, as a power of 1000; documents are counted above the occurrences in one number.
UNIT_THOUSANDS, DOCUMENT = 3, 1 << 40
#: Counts that a task holds before it hands them on, groups of a tile, numbers worked on at a time, and groups that are broadcast.
HELD, TILE, CELLS, BROADCAST = 200_000, 512, 1 << 20, 100_000
#: Parts in which a group's first terms are found before they meet.
PARTS = 64
#: A term is heavy if it occurs in this share of its language's groups.
HEAVY = 0.25


@dataclass
class Groups:
    """The (lang, source) groups, numbered in order, so that those of a language are neighbours; `first` has where each language begins."""

    names: list[tuple[str, str]]
    langs: list[str] = field(init=False)
    first: np.ndarray = field(init=False)
    lang_of: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.names = sorted(self.names)
        self.langs = sorted({lang for lang, _ in self.names})
        number = {lang: k for k, lang in enumerate(self.langs)}
        self.lang_of = np.array([number[lang] for lang, _ in self.names], np.int64)
        self.first = np.searchsorted(self.lang_of, np.arange(len(self.langs) + 1))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(1000^UNIT_THOUSANDS * counts / totals), by long division, so that no product leaves 64 bits below totals of 9e15."""
    out, rest = np.divmod(counts, totals)
    for _ in range(UNIT_THOUSANDS):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return 1 + out


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def term_counts(docs: DataFrame, groups: Groups) -> DataFrame:
    """(lang, group, term, n, docs) by number, summed in each task; a term's rows of one group are as many as the tasks that met it, or a few more.

    docs has the columns text, lang and source without nulls."""
    number = {name: k for k, name in enumerate(groups.names)}
    lang_of = groups.lang_of

    def batch(held: dict[int, dict[bytes, int]]) -> pa.RecordBatch:
        group = np.repeat(np.array([*held], np.int64), [len(x) for x in held.values()])
        packed = np.array([n for x in held.values() for n in x.values()], np.int64)
        terms = pa.array([t for x in held.values() for t in x], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang_of[group], pa.int32()), pa.array(group, pa.int32()), terms, pa.array(packed % DOCUMENT), pa.array(packed // DOCUMENT)], ["lang", "group", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, int]] = {}
        size = 0
        for rows in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                own = held.setdefault(number[lang, source], {})
                before = len(own)
                for term, n in Counter(TERM.findall(text.encode().lower())).items():
                    own[term] = own.get(term, 0) + n + DOCUMENT
                size += len(own) - before
                if size > HELD:
                    yield batch(held)
                    held, size = {}, 0
        if size:
            yield batch(held)

    return docs.select("text", "lang", "source").mapInArrow(count, "lang int, group int, term string, n long, docs long")


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, n, held) of the terms of at least min_docs documents of a language; held has (group, n) of each group with the term.
    One shuffle serves both sums."""
    cells = counts.repartition("lang", "term").groupBy("lang", "term", "group").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = F.collect_list(F.struct("group", "n")).alias("held")
    return cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), held).where(F.col("docs") >= min_docs).drop("docs")


class Tile:
    """Sums of gaps(p, q) over terms, p of a row's group and q of a column's, for the groups a..b of a language and all its groups."""

    def __init__(self, totals: np.ndarray, a: int, b: int) -> None:
        self.a, self.b, self.totals = a, b, totals
        self.absent = shares(np.ones_like(totals), totals)
        self.sums = np.zeros((b - a, len(totals)), np.int64)
        self.light, self.met = 0, np.zeros((0, 3), np.int64)  # number of light terms; of group, count and how many terms have that

    def add(self, sizes: np.ndarray, group: np.ndarray, n: np.ndarray, heavy: float) -> None:
        """Terms with their postings one after another; sizes has how many each has."""
        ends, p = np.cumsum(sizes), shares(n + 1, self.totals[group])
        dense = sizes >= heavy * len(self.totals)
        for k in np.unique(sizes):
            rows = np.flatnonzero(sizes == k)
            many = dense[rows[0]]
            step = max(1, CELLS // (len(self.totals) ** 2 if many else int(k) ** 2))
            for c in range(0, len(rows), step):
                at = ends[rows[c : c + step], None] - k + np.arange(k)
                (self._dense if many else self._sparse)(group[at], p[at])
        sparse = np.repeat(~dense, sizes)
        self.light += int((~dense).sum())
        met = np.column_stack((group[sparse], n[sparse], np.ones(sparse.sum(), np.int64)))
        self.met = self._merged(np.concatenate((self.met, met)))

    @staticmethod
    def _merged(met: np.ndarray) -> np.ndarray:
        order = np.lexsort((met[:, 1], met[:, 0]))
        met = met[order]
        new = np.flatnonzero(np.any(np.diff(met[:, :2], axis=0, prepend=-1), axis=1))
        return np.column_stack((met[new, :2], np.add.reduceat(met[:, 2], new))) if len(met) else met

    def _dense(self, group: np.ndarray, p: np.ndarray) -> None:
        """All groups of a block of terms at once, some rows of the tile at a time."""
        whole = np.tile(self.absent, (len(group), 1))
        np.put_along_axis(whole, group, p, axis=1)
        step = max(1, CELLS // whole.size)
        for i in range(self.a, self.b, step):
            j = min(i + step, self.b)
            self.sums[i - self.a : j - self.a] += gaps(whole[:, i:j, None], whole[:, None, :]).sum(0)

    def _sparse(self, group: np.ndarray, p: np.ndarray) -> None:
        """What the postings of a term change in pairs of its groups, beyond what each of the two changes alone."""
        term, x, y = np.nonzero((group[:, :, None] != group[:, None, :]) & (group[:, :, None] >= self.a) & (group[:, :, None] < self.b))
        i, j, p_i, p_j = group[term, x], group[term, y], p[term, x], p[term, y]
        no_i, no_j = self.absent[i], self.absent[j]
        np.add.at(self.sums, (i - self.a, j), gaps(p_i, p_j) - gaps(p_i, no_j) - gaps(no_i, p_j) + gaps(no_i, no_j))

    def finished(self) -> np.ndarray:
        """The sums, with what light terms add where a pair has none of them or one alone."""
        absent, rows = self.absent, self.absent[self.a : self.b]
        none = gaps(rows[:, None], absent[None, :])
        out = self.sums + self.light * none
        p = shares(self.met[:, 1] + 1, self.totals[self.met[:, 0]])
        ends = np.searchsorted(self.met[:, 0], np.arange(len(absent) + 1))
        step = max(1, CELLS // len(absent))
        for g in range(len(absent)):
            for c in range(ends[g], ends[g + 1], step):
                at = slice(c, min(c + step, ends[g + 1]))
                times, own = self.met[at, 2], p[at, None]
                if self.a <= g < self.b:
                    out[g - self.a] += times @ (gaps(own, absent[None, :]) - none[g - self.a])
                out[:, g] += times @ (gaps(rows[None, :], own) - none[:, g])
        return out


def pair_sums(kept: DataFrame, groups: Groups, totals: np.ndarray, heavy: float = HEAVY, tile: int = TILE) -> DataFrame:
    """(group, other, value) of all pairs of a language's groups with kept terms; value is summed in each task, tile by tile.

    A language of more than `tile` groups has several tiles; its terms are then copied for each and dealt out by it."""
    first = groups.first
    tiles = F.array(*[F.lit(int(-(-(b - a) // tile))) for a, b in zip(first[:-1], first[1:], strict=True)])
    rows = kept.select("lang", "held", F.lit(0).alias("tile"))
    if len(first) > 1 and np.diff(first).max() > tile:
        copies = F.explode(F.sequence(F.lit(0), tiles[F.col("lang")] - 1)).alias("tile")
        rows = kept.select("lang", "held", copies, F.pmod(F.xxhash64("term"), F.lit(64)).alias("salt")).repartition("lang", "tile", "salt").drop("salt")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], Tile] = {}
        for batch in batches:
            lang, held, number = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            sizes, cells = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), held.flatten()
            group, n = (cells.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for key in sorted(set(zip(lang.tolist(), number.tolist(), strict=True))):
                begin, end = first[key[0]], first[key[0] + 1]
                if key not in made:
                    a = key[1] * tile
                    made[key] = Tile(totals[begin:end], a, min(a + tile, end - begin))
                own = (lang == key[0]) & (number == key[1])
                cells_own = np.repeat(own, sizes)
                made[key].add(sizes[own], group[cells_own] - begin, n[cells_own], heavy)
        for (k, _), done in made.items():
            sums = done.finished()
            x, y = np.indices(sums.shape)
            yield pa.RecordBatch.from_pydict({"group": (x.ravel() + done.a + first[k]).astype(np.int32), "other": (y.ravel() + first[k]).astype(np.int32), "value": sums.ravel()})

    return rows.mapInArrow(add, "group int, other int, value long").groupBy("group", "other").agg(F.sum("value").alias("value"))


def share(count: str, total: str) -> Column:
    """shares() of columns; decimals hold the products."""
    return (1 + F.expr(f"(CAST({count} + 1 AS DECIMAL(28, 0)) * {1000**UNIT_THOUSANDS}) DIV CAST({total} AS DECIMAL(20, 0))")).cast("long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and which terms it has too often.

    Null texts, languages and sources count as empty ones; each row is a document, so repeated rows count again; other
    columns are not looked at; ties fall to the first item in order of UTF-8; an empty table gives no rows, and a language without kept terms pairs of value 0. The groups go
    through the driver and to every task, for the result has their square; terms never do. Part `pair` has all pairs, part
    `term` the `top` first terms of each group."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    spark = docs.sparkSession
    groups = Groups([tuple(r) for r in texts.select("lang", "source").distinct().collect()])
    kept = cut(kept_terms(term_counts(texts, groups), min_docs))
    vocabulary, occurrences = np.zeros((2, len(groups.langs)), np.int64)
    for r in kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("n")).collect():
        vocabulary[r["lang"]], occurrences[r["lang"]] = r["terms"], r["n"]
    totals = vocabulary[groups.lang_of]
    for r in kept.select(F.inline("held")).groupBy("group").agg(F.sum("n").alias("n")).collect():
        totals[r["group"]] += r["n"]

    columns = {
        "group": pa.array(range(len(groups.names)), pa.int32()), "lang": pa.array([x for x, _ in groups.names], pa.string()), "source": pa.array([x for _, x in groups.names], pa.string()),
        "total": pa.array(totals, pa.int64()), "lang_total": pa.array((vocabulary + occurrences)[groups.lang_of], pa.int64()),
    }
    known = spark.createDataFrame(pa.table(columns))
    known = F.broadcast(known) if len(groups.names) <= BROADCAST else known
    cells = kept.select("term", F.col("n").alias("lang_n"), F.inline("held")).join(known, "group")
    cells = cells.select("group", "lang", "source", "term", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q")).where("p > q")
    cells = cells.select("group", "lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) DIV q").alias("value"))
    in_order = [F.desc("value"), "item"]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*in_order))).where(F.col("rank") <= top)
    shares_of = first(cells.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), "group", "part")  # else a group's task reads `top` rows of every task
    ranked = first(shares_of.drop("rank", "part"), "group")
    terms = ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    sums = pair_sums(kept, groups, np.maximum(totals, 1))
    others = known.select(F.col("lang").alias("_lang"), F.col("group").alias("other"), F.col("source").alias("item"))
    pairs = known.select("group", "lang", "source").join(others, (F.col("lang") == F.col("_lang")) & (F.col("group") != F.col("other")))
    pairs = pairs.join(sums, ["group", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*in_order)))
    return pairs.unionByName(terms)
