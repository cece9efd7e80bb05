"""Mixing sources to target weights: membership patterns, min-cost flow to source quotas, seeded documents."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.runtime import WORD, cut, cut_slim

#: Hash buckets of a pattern's documents; only one bucket of each pattern is ever ordered row by row.
BUCKETS = 4096
#: Most membership patterns that the driver routes, in seconds; more are an error, not a cut. What is known of each, a row
#: of a few numbers, is broadcast.
MAX_PATTERNS = 100_000
#: Times that what is left of a quota is filled with documents that still fit.
PASSES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(source: str | None) -> tuple:
    return (source is None, source or "")


def water_fill(sizes: dict, total: int, weights: tuple[float, ...], epochs: int) -> dict:
    """Targets by weight that stop at `epochs` times the size; what is over is shared again by weight.

    Sources take the weights in turn, in code point order, null last.
    """
    order = sorted(sizes, key=source_order)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    targets, rest, free = {}, float(total), order
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > epochs * sizes[s]]
        if not over:
            return targets | {s: unit * weight[s] for s in free}
        targets |= {s: float(epochs * sizes[s]) for s in over}
        rest -= sum(targets[s] for s in over)
        free = [s for s in free if s not in targets]
    return targets


class Flow:
    """Min-cost flow on integer capacities by the primal-dual method: shortest distances once for each cost of a path,
    and all paths of that cost filled together, level by level."""

    def __init__(self) -> None:
        self.number: dict = {}
        self.at: list[list[int]] = []
        self.to: list[int] = []  # an arc's reverse has the next odd or even number
        self.left: list[int] = []
        self.cost: list[int] = []

    def node(self, name) -> int:
        if name not in self.number:
            self.number[name] = len(self.at)
            self.at.append([])
        return self.number[name]

    def arc(self, a, b, capacity: int, cost: int) -> int:
        a, b = self.node(a), self.node(b)
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def sent(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def run(self, begin, end) -> None:
        begin, end = self.node(begin), self.node(end)
        potential = [0] * len(self.at)
        while (far := self._distances(begin, potential)).get(end) is not None:
            potential = [p + min(far.get(x, far[end]), far[end]) for x, p in enumerate(potential)]
            while level := self._levels(begin, end, potential):
                self._fill_paths(begin, end, potential, level)

    def _distances(self, begin: int, potential: list[int]) -> dict[int, int]:
        done: dict[int, int] = {}
        queue = [(0, begin)]
        while queue:
            far, x = heapq.heappop(queue)
            if x in done:
                continue
            done[x] = far
            for k in self.at[x]:
                if self.left[k] and self.to[k] not in done:
                    heapq.heappush(queue, (far + self.cost[k] + potential[x] - potential[self.to[k]], self.to[k]))
        return done

    def _free(self, k: int, x: int, potential: list[int]) -> bool:
        return self.left[k] > 0 and self.cost[k] + potential[x] == potential[self.to[k]]

    def _levels(self, begin: int, end: int, potential: list[int]) -> dict[int, int]:
        """Steps from begin over arcs of shortest paths; empty if those do not reach the end."""
        level, now = {begin: 0}, [begin]
        while now and end not in level:
            following = []
            for x in now:
                for k in self.at[x]:
                    if self.to[k] not in level and self._free(k, x, potential):
                        level[self.to[k]] = level[x] + 1
                        following.append(self.to[k])
            now = following
        return level if end in level else {}

    def _fill_paths(self, begin: int, end: int, potential: list[int], level: dict[int, int]) -> None:
        tried = defaultdict(int)
        path, x = [], begin
        while True:
            if x == end:
                step = min(self.left[k] for k in path)
                for k in path:
                    self.left[k] -= step
                    self.left[k ^ 1] += step
                full = next(n for n, k in enumerate(path) if not self.left[k])
                x = self.to[path[full] ^ 1]
                del path[full:]
            arcs = self.at[x]
            while tried[x] < len(arcs):
                k = arcs[tried[x]]
                if level.get(self.to[k]) == level[x] + 1 and self._free(k, x, potential):
                    break
                tried[x] += 1
            if tried[x] < len(arcs):
                path.append(arcs[tried[x]])
                x = self.to[path[-1]]
            elif path:
                x = self.to[path.pop() ^ 1]
                tried[x] += 1
            else:
                return


def route(patterns: dict[tuple, int], quotas: dict, epochs: int) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources, by the flow: the n-th repetition of a pattern's words costs
    n(n+1)/2, so that repetition is spread; quotas are filled as far as the patterns reach."""
    flow, used = Flow(), {}
    for members, size in sorted(patterns.items(), key=lambda x: [source_order(s) for s in x[0]]):
        for k in range(epochs):
            flow.arc("begin", ("pattern", members), size, k * (k + 1) // 2)
        used[members] = {s: flow.arc(("pattern", members), ("source", s), epochs * size, 0) for s in members}
    for s in sorted({s for members in patterns for s in members}, key=source_order):
        flow.arc(("source", s), "end", quotas[s], 0)
    flow.run("begin", "end")
    return {members: {s: flow.sent(k) for s, k in arcs.items()} for members, arcs in used.items()}


def _fill(now: DataFrame, turn: int) -> DataFrame:
    """now with more = 1 for the unchosen documents that fit, in a seeded order, into what is left of their key.

    Their words are summed by hash bucket; buckets below the one where the rest runs out are chosen whole, and
    only the rows of that one are ordered.
    """
    used = now.groupBy("key").agg((F.max("rest") - F.sum(F.col("size") * F.col("more"))).alias("left"))
    turned = F.xxhash64("order", F.lit(turn))
    now = now.join(F.broadcast(used), "key").withColumn("turn", turned).withColumn("bucket", F.pmod("turn", F.lit(BUCKETS)))
    fits = (F.col("more") == 0) & (F.col("size") <= F.col("left"))
    in_order = Window.partitionBy("key").orderBy("bucket")
    buckets = now.where(fits).groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    buckets = buckets.withColumn("before", F.sum("words").over(in_order) - F.col("words")).where("before <= left")
    edge = buckets.groupBy("key").agg(F.max(F.struct("bucket", "before")).alias("edge"))
    placed = now.join(F.broadcast(edge.select("key", F.col("edge.bucket").alias("last"), F.col("edge.before").alias("before"))), "key", "left")
    at_edge = fits & (F.col("bucket") == F.col("last"))
    within = Window.partitionBy("key").orderBy("turn", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.where(~F.coalesce(at_edge, F.lit(False))).withColumn("more", F.when(fits & (F.col("bucket") < F.col("last")), 1).otherwise(F.col("more")))
    partly = placed.where(at_edge).withColumn("more", (F.col("before") + F.sum("size").over(within) <= F.col("left")).cast("int"))
    return cut_slim(whole.unionByName(partly).drop("left", "turn", "bucket", "last", "before"))


def _last_changes(now: DataFrame) -> DataFrame:
    """key, into and out: the document to choose, and perhaps the one to give up for it, that bring the key's words
    nearest to its rest; keys that are as near as that already are not listed.

    Of the documents of a size, only the first in order can matter, so a key is ordered by its different sizes."""
    state = now.groupBy("key").agg((F.max("rest") - F.sum(F.col("size") * F.col("more"))).alias("left")).where("left > 0")
    state = cut_slim(state)
    firsts = now.where("size > 0").groupBy("key", "more", "size").agg(F.min(F.struct("order", "row")).alias("first"))
    near = cut_slim(firsts.join(F.broadcast(state), "key").select("key", "more", "size", "left", "first.order", "first.row"))
    off = F.abs(F.col("size") - F.col("left"))
    added = near.where("more = 0").where(off < F.col("left")).select("key", F.struct(off.alias("off"), "order", F.lit(None).cast("long").alias("out_order"), F.col("row").alias("into"), F.lit(None).cast("long").alias("out")).alias("change"))
    near = near.withColumn("place", F.col("size") + F.col("left") * F.col("more"))
    by_size = Window.partitionBy("key").orderBy("place", "more").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("key").orderBy(F.desc("place"), F.desc("more")).rowsBetween(Window.unboundedPreceding, -1)
    free = F.when(F.col("more") == 0, F.struct("row", "size", "order"))
    below, above = (F.last(free, ignorenulls=True).over(w) for w in (by_size, down))
    swaps = near.withColumn("free", F.array(below, above)).where("more = 1").select("key", "left", "size", "order", "row", F.explode("free").alias("f")).where("f is not null")
    off = F.abs(F.col("f.size") - F.col("size") - F.col("left"))
    swaps = swaps.where(off < F.col("left")).select("key", F.struct(off.alias("off"), F.col("f.order").alias("order"), F.col("order").alias("out_order"), F.col("f.row").alias("into"), F.col("row").alias("out")).alias("change"))
    best = added.unionByName(swaps).groupBy("key").agg(F.min("change").alias("change"))
    return cut_slim(best.select("key", "change.into", "change.out"))


def mix(
    docs: DataFrame,
    id_col: str,
    size: Column,
    sources: Column,
    weights: tuple[float, ...] = (5, 2, 1),
    epochs: int = 3,
    share: float = 1.0,
    seed: int = 7,
) -> tuple[DataFrame, dict, dict]:
    """A mix of share times all words: (rows of id, size, sources, taken), {source: (size, target)}, routes.

    sources is an array of the sources a document belongs to (null is a source like any other; an empty or null
    array counts as the null source). A source's size is that of all its documents. Patterns of membership are summed in Spark, the flow
    runs on those sums, and every pattern's documents are then taken as often as its flow needs: whole rounds, and
    one more time for documents in a seeded order until the rest is filled, at last by adding or exchanging the document that
    comes nearest to it. Documents are taken whole. Each row is a document of its own, known by a number and not by its id,
    which may be null or repeated; rows of one id and size are alike, so that reruns agree. Size null counts 0. An empty
    table gives no rows.
    """
    members = F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    key = F.array_join(F.transform(members, lambda s: F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("-"))), "")
    unnamed = F.xxhash64(F.lit(seed), F.coalesce(size, F.lit(0)).cast("long"), F.lit("unnamed"))
    order = F.when(F.col(id_col).isNull(), unnamed).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    sized = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), members.alias("sources"), key.alias("key"), order.alias("order"), F.monotonically_increasing_id().alias("row")))
    sums = sized.groupBy("key").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    patterns = {tuple(sorted(r["sources"], key=source_order)): r["size"] for r in sums}
    keys = {tuple(sorted(r["sources"], key=source_order)): r["key"] for r in sums}
    sizes: dict = defaultdict(int)
    for m, n in patterns.items():
        for s in m:
            sizes[s] += n
    targets = water_fill(sizes, round(share * sum(patterns.values())), weights, epochs)
    routes = route(patterns, {s: round(t) for s, t in targets.items()}, epochs)
    wanted = [(keys[m], (w := sum(routes[m].values())) // max(n, 1), w % max(n, 1)) for m, n in patterns.items()]
    columns = list(zip(*wanted, strict=True)) or [[], [], []]
    kinds = {"key": pa.string(), "rounds": pa.int64(), "rest": pa.int64()}
    rest = sized.sparkSession.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)}))

    now = sized.join(F.broadcast(rest), "key").withColumn("more", F.lit(0))
    for k in range(PASSES):
        now = _fill(now, k)
    changes = _last_changes(now)
    full = now.join(F.broadcast(changes), "key", "left")
    into, out = F.col("row") == F.col("into"), F.col("row") == F.col("out")
    more = F.when((F.col("more") == 0) & into, 1).when((F.col("more") == 1) & out, 0).otherwise(F.col("more"))
    rows = full.select(F.col("id").alias(id_col), "size", "sources", (F.col("size") * (F.col("rounds") + more)).alias("taken"))
    return rows, {s: (sizes[s], targets[s]) for s in sizes}, {m: dict(r) for m, r in routes.items()}
