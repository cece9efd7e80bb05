"""Queues, pages, samples and nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.vectors import cosine_distance, dot

URGENCY_ORDER = {"critical": 0, "high": 1, "normal": 2}


def rank_of(value: Column, order: dict[str, int]) -> Column:
    """The place of a value in an order; unlisted and null values come last."""
    out = F.lit(max(order.values()) + 1)
    for name, place in order.items():
        out = F.when(value == name, place).otherwise(out)
    return out


def page(df: DataFrame, *order: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a list in a total order; the page size is between 1 and 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def review_queue(claims: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Claims in review: critical first, the oldest first of a level."""
    waiting = claims.where("status = 'in_human_review'")
    return page(waiting, rank_of(F.col("urgency"), URGENCY_ORDER), F.asc("created_at"), F.asc("id"), limit=limit, offset=offset)


def matching(df: DataFrame, equal: dict, unlike: dict | None = None) -> DataFrame:
    """Rows with equal values and without the unlike ones, where null is unlike nothing; keys without value are
    ignored."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, value in (unlike or {}).items():
        if value is not None:
            df = df.where(~F.col(name).eqNullSafe(value))
    return df


def nearest(df: DataFrame, query: Column, vector: str, key: str, k: int = 5) -> DataFrame:
    """The k rows of least cosine distance with their score, exactly; filters go before. Ties fall to the key. Each
    task keeps k rows, so that only those meet."""
    ranked = df.withColumn("_distance", cosine_distance(F.col(vector), query)).where("_distance is not null")
    top = ranked.orderBy("_distance", key).limit(k)
    return top.withColumn("score", F.round(1 - F.col("_distance"), 4)).drop("_distance")


def best_of_group(df: DataFrame, group: str, query: Column, vector: str, position: str) -> DataFrame:
    """The row of each group with the largest inner product, the first of equal ones."""
    best = df.groupBy(group).agg(F.max_by(F.struct(*df.columns), F.struct(dot(F.col(vector), query), -F.col(position))).alias("_row"))
    return best.select("_row.*")


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """per_stratum rows of each stratum, drawn by a seeded hash of the key; a stratum that has fewer raises."""
    short = [r[0] for r in df.groupBy(stratum).count().where(F.col("count") < per_stratum).collect()]
    if short:
        raise ValueError(f"fewer than {per_stratum} rows: {short}")
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    order = Window.partitionBy(stratum).orderBy("_drawn", key)
    return df.withColumn("_drawn", drawn).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_stratum).drop("_n", "_drawn")


def split_slices(df: DataFrame, label: str, key: str, tune: int, holdout: int, seed: int = 42) -> DataFrame:
    """Equal slices for each label from one seeded order: the first `tune` rows, then `holdout` rows, as column split."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    placed = df.withColumn("_n", F.row_number().over(order))
    return placed.where(F.col("_n") <= tune + holdout).withColumn("split", F.when(F.col("_n") <= tune, "tune").otherwise("holdout")).drop("_n")


def take_phases(df: DataFrame, phases: list[dict], key: str) -> DataFrame:
    """The first `count` unused matches of each phase {equal, unlike, count}, in order of the key, with its number."""
    used, out = None, None
    for number, phase in enumerate(phases):
        left = df if used is None else df.join(used, key, "left_anti")
        taken = matching(left, phase.get("equal", {}), phase.get("unlike")).orderBy(key).limit(phase["count"]).withColumn("phase", F.lit(number))
        out = taken if out is None else out.unionByName(taken)
        used = out.select(key)
    return out
