"""Approximate nearest neighbours by a hash-prefix forest: in each tree all vectors stand in the order of a long hash
string; queries descend to their longest matching prefixes and all trees ascend together until there is enough."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.runtime import cut, cut_slim

#: Trees, symbols of a hash string, first symbols that a query tries in each tree, and vectors of a block.
TREES, SYMBOLS, PROBES, BLOCK = 16, 6, 4, 8192
#: Trees ascend until they hold this share of all vectors, and at least so many, counted once for each tree.
SHARE, LEAST = 0.3, 4000


@lru_cache(maxsize=4)
def rotations(dim: int, trees: int, symbols: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(trees * symbols)]).astype(np.float32)


class Codes:
    """Hash strings of cross-polytope symbols: the nearest of all axes, both ways, of a random rotation."""

    def __init__(self, dim: int, trees: int, symbols: int, seed: int) -> None:
        self.bits = max(1, (2 * dim - 1).bit_length())
        self.dim, self.trees, self.seed = dim, trees, seed
        self.symbols = min(symbols, 62 // self.bits)

    def of(self, vectors: np.ndarray, tree: int, probes: int = 1) -> np.ndarray:
        """Codes in one tree, vectors x probes: the other probes have the next best first symbols."""
        code = np.zeros((len(vectors), probes), np.int64)
        for level in range(self.symbols):
            turned = vectors @ rotations(self.dim, self.trees, self.symbols, self.seed)[tree * self.symbols + level]
            size = np.abs(turned)
            if level == 0 and probes > 1:
                axis = np.argsort(-size, axis=1, kind="stable")[:, :probes]
            else:
                axis = size.argmax(1)[:, None]
            symbol = 2 * axis + (np.take_along_axis(turned, axis, axis=1) > 0)
            code = code << self.bits | symbol
        return code

    def bounds(self, code: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """First code with the same `level` symbols and the first after the last."""
        shift = self.bits * (self.symbols - level)
        low = code >> shift << shift
        return low, low + (np.int64(1) << shift)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def usable(vector: Column, dim: int) -> Column:
    """Vectors of that length without null or non-finite components that are not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    probes: int = PROBES,
    share: float = SHARE,
    least: int = LEAST,
    seed: int = 11,
) -> DataFrame:
    """The k nearest found, by inner product, of each row for which `queries` holds: query_id, rank, id, score.

    All other rows are candidates. Vectors of the most common length take part (of equal ones the shortest), if they
    have no null or non-finite component and are not zero; a row with a null id takes no part and repeated rows count
    once. Equal vectors meet as one and are told apart at the end; ties go to the smaller id. An empty table, or one
    without queries, gives no rows. Every vector is in every tree; blocks of a tree's order hold equally many.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 1
    rows = rows.where(usable(F.col("v"), dim)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("vector"), F.col("v"))})
    distinct = cut_slim(rows.groupBy("h1", "h2").agg(F.min("id").alias("vid"), F.first("v").alias("v"), F.max("asks").alias("asks")))
    members = cut_slim(rows.select("id", "asks", "h1", "h2").distinct().join(distinct.select("h1", "h2", "vid"), ["h1", "h2"]).select("id", "asks", "vid"))
    total = distinct.count()
    codes = Codes(dim, trees, SYMBOLS, seed)
    element = vectors.schema[vector_col].dataType.elementType.typeName()
    exact, kind = ("float", np.float32) if element == "float" else ("double", np.float64)  # scores are those of the vectors as they are
    wanted = max(least, int(share * total))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                x = matrix(b.column("v"), dim)
                for t in range(trees):
                    yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(x), t, np.int32)), "code": codes.of(x, t)[:, 0], "vid": b.column("vid")})

    n_blocks = max(1, -(-total * trees // BLOCK))
    ordered = distinct.select("vid", "v").mapInArrow(index, "tree int, code long, vid long").repartitionByRange(n_blocks, "tree", "code", "vid")
    forest = cut(ordered.withColumn("block", F.spark_partition_id()))
    edges = forest.groupBy("block", "tree").agg(F.min("code").alias("low"), F.max("code").alias("high")).orderBy("tree", "low", "high", "block").toPandas()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                x = matrix(b.column("v"), dim)
                vid = b.column("vid").to_numpy()
                for t in range(trees):
                    code = codes.of(x, t, min(probes, dim))
                    yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(code.size, t, np.int32)), "code": code.ravel(), "vid": np.repeat(vid, code.shape[1])})

    asked = cut(distinct.where("asks").select("vid", "v").mapInArrow(ask, "tree int, code long, vid long"))

    def spread(level: Column) -> Column:
        """The blocks that hold the codes with the same `level` symbols; at level 0 those of the first tree."""

        @F.pandas_udf("array<int>")
        def udf(tree: pd.Series, code: pd.Series, at: pd.Series) -> pd.Series:
            low, high = codes.bounds(code.to_numpy(np.int64), at.to_numpy(np.int64))
            out = []
            for t, a, b in zip(tree, low, high, strict=True):
                some = edges[edges["tree"] == t] if t not in by_tree else by_tree[t]
                by_tree.setdefault(t, some)
                out.append(some["block"].to_numpy()[(some["low"].to_numpy() < b) & (some["high"].to_numpy() >= a)].tolist())
            return pd.Series(out)

        by_tree: dict = {}
        return udf("tree", "code", level)

    def count(key: tuple, held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """How many codes of the block share at least so many symbols with each asked code."""
        out = []
        for t, some in asks.groupby("tree"):
            order = np.sort(held["code"].to_numpy(np.int64)[held["tree"].to_numpy() == t])
            for level in range(1, codes.symbols + 1):
                low, high = codes.bounds(some["code"].to_numpy(np.int64), level)
                out.append(pd.DataFrame({"vid": some["vid"], "level": level, "n": np.searchsorted(order, high) - np.searchsorted(order, low)}))
        found = pd.concat(out) if out else pd.DataFrame({"vid": [], "level": [], "n": []})
        return found.groupby(["vid", "level"], as_index=False)["n"].sum().astype("int64")

    first = asked.withColumn("block", F.explode(spread(F.lit(1))))
    counts = forest.groupBy("block").cogroup(first.groupBy("block")).applyInPandas(count, "vid long, level long, n long")
    stops = counts.groupBy("vid", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= wanted).groupBy("vid").agg(F.max("level").alias("level"))

    def search(key: tuple, held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 best of the block for each asked code, by exact inner products in double precision."""
        out_vid, out_near, out_score = [], [], []
        for t, some in asks.groupby("tree"):
            mine = held[held["tree"] == t].sort_values(["code", "vid"])
            if not len(mine):
                continue
            order, near = mine["code"].to_numpy(np.int64), mine["vid"].to_numpy(np.int64)
            x = np.frombuffer(b"".join(mine["v"]), kind).reshape(-1, dim).astype(np.float64)
            low, high = codes.bounds(some["code"].to_numpy(np.int64), some["level"].to_numpy(np.int64))
            a, b = np.searchsorted(order, low), np.searchsorted(order, high)
            vid, q = some["vid"].to_numpy(np.int64), np.frombuffer(b"".join(some["v"]), kind).reshape(-1, dim).astype(np.float64)
            groups = pd.Series(np.arange(len(a))).groupby([a, b]).indices
            for (i, j), at in groups.items():
                if i == j:
                    continue
                for part in np.array_split(at, max(1, -(-len(at) * (j - i) // 2_000_000))):
                    rough = q[part] @ x[i:j].T
                    keep = min(2 * k + 2, j - i)
                    best = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
                    margin = 1e-12 * np.linalg.norm(q[part], axis=1) * np.linalg.norm(x[i:j], axis=1).max()  # of rounding in products
                    floor = np.take_along_axis(rough, best, axis=1).min(1) - margin
                    tied = (rough >= floor[:, None]).sum(1) > keep
                    for row, one in enumerate(part):
                        pick = np.flatnonzero(rough[row] >= floor[row]) if tied[row] else best[row]
                        score = (x[i + pick] * q[one]).sum(1)
                        top = np.lexsort((near[i + pick], -score))[: k + 1]
                        out_vid.append(np.full(len(top), vid[one]))
                        out_near.append(near[i + pick[top]])
                        out_score.append(score[top])
        if not out_vid:
            return pd.DataFrame({"vid": [], "near": [], "score": []})
        return pd.DataFrame({"vid": np.concatenate(out_vid), "near": np.concatenate(out_near), "score": np.concatenate(out_score)})

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, kind).tobytes() for x in v])

    plain = cut(distinct.select("vid", packed(F.col("v").cast(f"array<{exact}>")).alias("v")))
    levels = asked.join(stops, "vid", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    levels = levels.where("level > 0").unionByName(levels.where("level = 0 and tree = 0").groupBy("vid", "tree", "level").agg(F.min("code").alias("code")))
    second = levels.distinct().withColumn("block", F.explode(spread(F.col("level"))))
    second = second.join(plain, "vid").select(*(F.col(c).alias(c) for c in ("block", "tree", "code", "level", "vid", "v")))
    found = forest.join(plain, "vid").groupBy("block").cogroup(second.groupBy("block")).applyInPandas(search, "vid long, near long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    in_group = Window.partitionBy("vid").orderBy("id")
    copies = members.select("id", "vid").distinct().withColumn("n", F.row_number().over(in_group)).where(F.col("n") <= k + 1)
    for_vector = found.distinct().withColumnsRenamed({"vid": "query", "near": "vid"}).join(copies.drop("n"), "vid")
    for_vector = for_vector.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "id", "score")
    asking = members.where("asks").select(F.col("id").alias("query_id"), F.col("vid").alias("query"))
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    out = asking.join(for_vector, "query").where("id != query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
