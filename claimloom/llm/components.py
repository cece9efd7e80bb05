"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.runtime import cut_slim


#: Edges below which hubs are joined like any other node.
SMALL = 10_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges joined with what is known of their node u. Nodes of over a thousandth of all edges are few and are
    broadcast, so that no hub makes one task long."""
    if total < SMALL:
        return edges.join(least.drop("n"), "u")
    hub = F.col("n") > total // 1000
    few = F.broadcast(least.where(hub).drop("n"))  # at most 2000 rows
    rest = edges.join(few.select("u"), "u", "left_anti").join(least.where(~hub).drop("n"), "u")
    return edges.join(few, "u").unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node it reaches.

    Edges are two columns of one comparable type, in any direction; loops, repeats and nulls do no harm, and an
    empty table gives an empty result. A hub's edges are aggregated before they are shuffled and
    joined by a broadcast of the few hubs. Every round writes a checkpoint.
    """
    pairs = edges.where(F.col(src) != F.col(dst))
    now = cut_slim(pairs.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    state = _state(now)
    while state[0]:
        following = cut_slim(_small_star(_large_star(now, state[0]), state[0]).distinct())
        after = _state(following)
        now, state, before = following, after, state
        if after == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
