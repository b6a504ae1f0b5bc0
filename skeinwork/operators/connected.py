"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vertex with more than one in so many edge ends is a hub.
HUBS = 5_000


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(v, component) for every vertex of edges(u, v): component is the smallest vertex that can be reached.

    Each round makes every vertex point to the least of its neighbours, first among the larger ones and then among the
    smaller ones, until all edges lead to a root; the number of rounds grows with the logarithm of the graph. Minima are
    pre-aggregated before the shuffle. Edges of a hub, a vertex with more than a HUBS-th of all edge ends, get its minimum
    by broadcast and stay where they are; there are HUBS such vertices at most, whatever the input. `cut` stores a round's
    edges and returns them read back, so that plans stay short and lost executors cost one round.
    """
    pairs = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(pairs)
    while True:
        pairs = cut(_small(cut(_large(pairs, mark[0])), mark[0]))
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("v").alias("x")).distinct()
    return pairs.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(roots.select(F.col("x").alias("v"), F.col("x").alias("component")))


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows(u, v) with m of least(u, m, n); n is the number of edges at u, which tells hubs."""
    most = max(100, 2 * edges // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    plain = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(plain)


def _large(pairs: DataFrame, edges: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(pairs: DataFrame, edges: int) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(pairs, least, edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
