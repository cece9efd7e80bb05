"""Exact quantiles from summaries: counts by bins of values that add up over any range, and passes over the one bin that holds a place."""

from __future__ import annotations

import functools
from collections.abc import Callable
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.shared import scratch

#: Bins for each doubling of the absolute value, a number beyond that of any value, and cells into which a pass divides a bin.
PER_DOUBLING, BEYOND, CELLS = 16, 20_000, 4096
#: Places that are broadcast to the rows; with more, rows and places meet by a shuffle.
FEW = 10_000
Rank = Callable[[Column], Column]


def disc(share: float) -> Rank:
    """The first place, from 1, that at least `share` of n values do not exceed."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(share))).cast("long")


def nearest_rank(share: float) -> Rank:
    """The place int(n * share) from 0, at most the last."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(share))).cast("long") + 1


def bin_of(value: Column) -> Column:
    """A whole number that never falls as the value rises: the logarithm of its size, by sign. NaN is beyond all."""
    size = F.abs(value)
    finite = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) * PER_DOUBLING).cast("int") + BEYOND
    level = F.coalesce(finite, F.when(size > 0, 2 * BEYOND).otherwise(0)).cast("int")
    return F.when(F.isnan(value), 3 * BEYOND).when(value < 0, -level).otherwise(level)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, bin, n, least, greatest) of the values that are not null: at most some 70,000 rows a key, and mostly a few hundred."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    return rows.groupBy(*keys, bin_of(F.col("_v")).alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))


def merged(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries over fewer keys, such as those of days over the ranges of days that a column of `keys` names."""
    return summaries.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def _same(a: list[str], b: list[str]) -> Column:
    return functools.reduce(and_, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))


def _placed(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Of cells (keys, cell, n, least, greatest, place), the one of each key that holds its place, with the place inside it."""
    one_by_one = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(cell)
    under = F.sum("n").over(one_by_one) - F.col("n")
    found = cells.withColumn("_under", under).where((F.col("_under") < F.col("place")) & (F.col("place") <= F.col("_under") + F.col("n")))
    return found.select(*keys, (F.col("place") - F.col("_under")).alias("place"), F.col("least").alias("low"), F.col("greatest").alias("high"))


def at_ranks(df: DataFrame, summaries: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """keys and a column for each of `ranks`: the value at that place of its key, exactly. Keys may be null; nulls among values do not count; keys
    without values give no row.

    df has the rows that `summaries` count. The summary gives the bin that holds a place; each pass divides what is in question into cells between its
    least and greatest value and counts them, until all values of a cell are equal. No task orders values, however many a key has or a value repeats."""
    of = [f"_of_{k}" for k in range(len(keys))]
    sizes = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_all")).alias("place")) for name, rank in ranks.items()]))
    cells = summaries.withColumn("_all", sizes).select("*", places.alias("_p")).select(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], "bin", "n", "least", "greatest", "_p.name", "_p.place")
    open_ = _placed(cells, [*of, "name"], "bin")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    done = None
    while True:
        open_ = _kept(open_)
        solved = (F.col("low") == F.col("high")) | F.isnan("low")
        now = open_.where(solved).select(*of, "name", "low")
        done = now if done is None else done.unionByName(now)
        open_ = open_.where(~solved)
        left = open_.count()
        if not left:
            break
        met = rows.join(F.broadcast(open_) if left <= FEW else open_, _same(keys, of) & F.col("_v").between(F.col("low"), F.col("high")))
        part = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        cell = F.least(F.lit(CELLS - 1), F.floor(part * CELLS)).cast("int")
        counted = met.groupBy(*of, "name", "place", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))
        open_ = _placed(counted, [*of, "name"], "cell")
    out = done.groupBy(*of).agg(*[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks])
    return out.withColumnsRenamed(dict(zip(of, keys, strict=True)))


def _kept(df: DataFrame) -> DataFrame:
    """A few rows a key, written so that no pass counts again what an earlier one has counted."""
    path = scratch(df.sparkSession, "places")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantiles(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """at_ranks() of rows without a kept summary."""
    return at_ranks(df, _kept(summary(df, keys, value)), keys, value, ranks)
