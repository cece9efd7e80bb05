"""Joins with a contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Unmatched(ValueError):
    """Rows without a partner where every row must have one."""


def strict_join(left: DataFrame, right: DataFrame, key: str, equal: tuple[str, ...] = ()) -> DataFrame:
    """Inner join that raises Unmatched if any row of either side has no partner, or if a column of `equal`, which
    both sides have, differs. One pass over a full join counts both."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumnsRenamed({c: f"_r_{c}" for c in equal}).withColumn("_r", F.lit(True))
    full = a.join(b, key, "full")
    differs = F.lit(False)
    for c in equal:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    counts = full.agg(F.count_if(F.col("_r").isNull()).alias("left"), F.count_if(F.col("_l").isNull()).alias("right"), F.count_if(F.col("_l") & F.col("_r") & differs).alias("differ")).first()
    if any(counts):
        raise Unmatched(f"{counts['left']} rows only left, {counts['right']} only right, {counts['differ']} differ")
    return a.join(b, key).drop("_l", "_r", *[f"_r_{c}" for c in equal])


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key other does not have: what a backfill still has to do."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def in_order_of(df: DataFrame, key: str, ids: DataFrame, position: str = "position") -> DataFrame:
    """The rows that the pinned list `ids` (key, position) names, in its order; an id without a row raises."""
    found = ids.join(df, key, "left")
    absent = [r[0] for r in missing_from(ids, df, key).select(key).limit(5).collect()]
    if absent:
        raise Unmatched(f"no rows for {absent}")
    return found.orderBy(position)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last in order: what an upsert leaves."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str, not_blank: str | None = None) -> DataFrame:
    """current with changes by key, the last in order winning; a blank value in not_blank raises."""
    if not_blank and changes.where(F.coalesce(F.trim(not_blank), F.lit("")) == "").limit(1).count():
        raise ValueError(f"blank {not_blank}")
    return latest(current.unionByName(changes.select(current.columns)), key, order)


def lookup_with_default(df: DataFrame, answers: DataFrame, key: str, default: str = "*") -> DataFrame:
    """df with the answer (a column payload) recorded for its key, or else that of the default key."""
    exact = answers.where(F.col(key) != default).select(key, F.col("payload").alias("_own"))
    other = answers.where(F.col(key) == default).agg(F.max("payload").alias("_any"))
    return df.join(exact, key, "left").join(F.broadcast(other)).withColumn("payload", F.coalesce("_own", "_any")).drop("_own", "_any")  # one row
