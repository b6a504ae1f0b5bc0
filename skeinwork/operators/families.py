"""Structured graph families as edge generators, and their layouts.

A family is a list of parts over its parameters a and b: integer ranges that are exploded, a filter, and the two end
labels. From that one description comes a DataFrame for any number of parameter rows at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """ranges: (name, first, last) in order, each may use the ones before; u, v: labels as SQL."""

    ranges: tuple[tuple[str, str, str], ...]
    u: str
    v: str
    where: str = "true"


@dataclass(frozen=True)
class Family:
    parts: tuple[Part, ...]
    least: int
    dedup: bool = False
    second: str | None = None


def s(x: str) -> str:
    return f"cast({x} as string)"


def named(prefix: str, x: str) -> str:
    return f"concat('{prefix}', cast({x} as string))"


def cell(x: str, y: str) -> str:
    return f"concat(cast({x} as string), '_', cast({y} as string))"


_I = (("i", "0", "a - 1"),)
_RING = Part(_I, s("i"), s("(i + 1) % a"))
_IJ = (("i", "0", "a - 1"), ("j", "0", "b - 1"))

#: a: the first parameter, b: the second.
FAMILIES = {
    "bouquet": Family((Part(_I, "'0'", "'0'"),), 0),
    "theta": Family((Part(_I, "'0'", "'1'"),), 1),
    "periodic_theta": Family((Part(_I, "'L'", named("m", "i")), Part(_I, named("m", "i"), "'R'"), Part(_I, named("m", "i"), named("m", "(i + 1) % a"))), 1),
    # words of b letters as numbers to base a: a shared prefix w, then i and b - 1 - k letters j against j and the letters i
    "sierpinski": Family((Part((("k", "0", "b - 1"), ("w", "0", "cast(power(a, k) as int) - 1"), ("i", "0", "a - 2"), ("j", "i + 1", "a - 1")), s("(w * a + i) * cast(power(a, b - 1 - k) as int) + j * ((cast(power(a, b - 1 - k) as int) - 1) / (a - 1))").replace(" / ", " div "), s("(w * a + j) * cast(power(a, b - 1 - k) as int) + i * ((cast(power(a, b - 1 - k) as int) - 1) / (a - 1))").replace(" / ", " div ")),), 2, second="2"),
    "complete_graph": Family((Part((("i", "0", "a - 2"), ("j", "i + 1", "a - 1")), s("i"), s("j")),), 1),
    "complete_bipartite": Family((Part(_IJ, named("l", "i"), named("r", "j")),), 1, second="3"),
    "complete_multipartite": Family((Part((("i", "0", "a - 1"), ("j", "0", "b - 1")), named("l", "i"), named("m", "j")), Part((("i", "0", "a - 1"),), named("l", "i"), "'r0'"), Part((("j", "0", "b - 1"),), named("m", "j"), "'r0'")), 1, second="2"),
    "fan": Family((Part(_I, "'c'", s("i")), Part((("i", "0", "a - 2"),), s("i"), s("i + 1"))), 2),
    "wheel": Family((Part(_I, "'c'", s("i")), _RING), 3),
    "ladder": Family((Part(_I, cell("i", "0"), cell("i", "1")), Part((("i", "0", "a - 2"), ("j", "0", "1")), cell("i", "j"), cell("i + 1", "j"))), 2),
    "circular_ladder": Family((Part(_I, cell("i", "0"), cell("i", "1")), Part((("i", "0", "a - 1"), ("j", "0", "1")), cell("i", "j"), cell("(i + 1) % a", "j"))), 3),
    "grid": Family((Part((("i", "0", "a - 1"), ("j", "0", "b - 2")), cell("i", "j"), cell("i", "j + 1")), Part((("i", "0", "a - 2"), ("j", "0", "b - 1")), cell("i", "j"), cell("i + 1", "j"))), 1, second="3"),
    "cylinder": Family((Part(_IJ, cell("i", "j"), cell("i", "(j + 1) % b")), Part((("i", "0", "a - 2"), ("j", "0", "b - 1")), cell("i", "j"), cell("i + 1", "j"))), 2, True, "3"),
    "hypercube": Family((Part((("i", "0", "cast(power(2, a) as int) - 1"), ("k", "0", "a - 1")), s("i"), s("i + cast(power(2, k) as int)"), "(i div cast(power(2, k) as int)) % 2 = 0"),), 1),
    "friendship": Family((Part((("i", "0", "2 * a - 1"),), "'c'", s("i")), Part(_I, s("2 * i"), s("2 * i + 1"))), 1),
    "windmill": Family((Part((("w", "0", "b - 1"), ("i", "0", "a - 2")), "'c'", cell("w", "i")), Part((("w", "0", "b - 1"), ("i", "0", "a - 3"), ("j", "i + 1", "a - 2")), cell("w", "i"), cell("w", "j"))), 2, second="2"),
    "circulant": Family((Part((("i", "0", "a - 1"), ("j", "1", "b")), s("i"), s("(i + j) % a"), "j % a <> 0"),), 2, True, "2"),
    "generalized_petersen": Family((_RING, Part(_I, s("i"), named("n", "i")), Part(_I, named("n", "i"), named("n", "(i + b) % a"))), 3, True, "2"),
    "mobius_ladder": Family((Part((("i", "0", "2 * a - 1"),), s("i"), s("(i + 1) % (2 * a)")), Part(_I, s("i"), s("i + a"))), 2),
}


def names() -> list[str]:
    return sorted(FAMILIES)


def edges(params: DataFrame, name: str) -> DataFrame:
    """(a, b, u, v) of the family for every row of params(a, b); parameters under the family's least are an error there
    and left out here. Sequences are guarded, so empty ranges give no rows."""
    family = FAMILIES[name]
    out = None
    for part in family.parts:
        rows = params.where(F.col("a") >= family.least).select("a", "b")
        for var, lo, hi in part.ranges:
            # the length first: with a step of one, an empty range has none
            rows = rows.where(F.expr(f"({hi}) >= ({lo})")).withColumn(var, F.explode(F.expr(f"sequence(cast({lo} as int), greatest(cast({lo} as int), cast({hi} as int)))")))
        rows = rows.where(part.where).select("a", "b", F.expr(part.u).alias("u"), F.expr(part.v).alias("v"))
        out = rows if out is None else out.unionByName(rows)
    if family.dedup:
        out = out.select("a", "b", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    return out


def normalised(rows: DataFrame) -> DataFrame:
    """rows(a, b, u, v) with the smaller label first."""
    return rows.select("a", "b", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def multipartite(params: DataFrame) -> DataFrame:
    """(sizes, u, v): complete multipartite graphs with any number of parts, for every row of params(sizes); labels are
    part_place, and vertices of different parts are joined."""
    rows = params.select("sizes", F.posexplode("sizes").alias("p", "n")).where("n > 0").withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    later = F.expr("filter(transform(sizes, (m, q) -> struct(q, m)), x -> x.q > p AND x.m > 0)")
    rows = rows.withColumn("o", F.explode(later)).withColumn("j", F.explode(F.expr("sequence(0, o.m - 1)")))
    return rows.select("sizes", F.concat_ws("_", "p", "i").alias("u"), F.concat_ws("_", "o.q", "j").alias("v"))


#: Sweeps of one parameter: its first value.
LINES = {"periodic_theta": 1, "complete_graph": 1, "fan": 2, "wheel": 3, "ladder": 2, "circular_ladder": 3, "hypercube": 1, "friendship": 1, "mobius_ladder": 2}
#: Sweeps of two: the ranges of a and b, what must hold, and the order.
PAIRS = {
    "sierpinski": ((2, 13), (1, 7), "true", "array(a * b, b, a)"),
    "complete_bipartite": ((1, 20), (1, 20), "a <= b", "array(a + b, b, a)"),
    "grid": ((1, 10), (1, 12), "true", "array(a * b, a + b, a, b)"),
    "cylinder": ((2, 10), (2, 12), "true", "array(a * b, a + b, a, b)"),
    "windmill": ((3, 10), (2, 20), "true", "array(1 + b * (a - 1), a + b, a, b)"),
    "generalized_petersen": ((5, 30), (1, 14), "2 * b < a", "array(a, b)"),
}
# The sets of jumps of circulant graphs.
JUMPS = ((1,), (2,), (1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (1, 2, 3))


def _tuple(x: str) -> str:
    return f"concat('(', array_join({x}, ', '), if(size({x}) = 1, ',)', ')'))"


def sweeps(spark: SparkSession, count: int) -> DataFrame:
    """(family, rank, params): the first `count` parameters of every family in the order of its sweep, as tuples."""
    row = spark.range(1, numPartitions=1)
    out = []
    for name, first in LINES.items():
        rows = row.select(F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("a"))
        out.append(rows.select(F.lit(name).alias("family"), F.array("a").alias("key"), F.expr(_tuple("array(a)")).alias("params")))
    for name, ((a0, a1), (b0, b1), holds, key) in PAIRS.items():
        rows = row.select(F.explode(F.sequence(F.lit(a0), F.lit(a1))).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(b0), F.lit(b1)))).where(holds)
        out.append(rows.select(F.lit(name).alias("family"), F.expr(key).alias("key"), F.expr(_tuple("array(a, b)")).alias("params")))
    # parts of five at most, the largest first, ten vertices in all
    parts = row.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).select(F.array("n").alias("p"))
    for _ in range(4):
        parts = parts.withColumn("n", F.explode(F.sequence(F.lit(1), F.element_at("p", -1)))).select(F.concat("p", F.array("n")).alias("p"))
        parts = parts.where("aggregate(p, 0, (s, x) -> s + x) <= 10")
        rows = parts.select(F.lit("complete_multipartite").alias("family"), F.expr("concat(array(aggregate(p, 0, (s, x) -> s + x), size(p)), p)").alias("key"), F.expr(_tuple("p")).alias("params"))
        out.append(rows)
    jumps = row.select(F.explode(F.sequence(F.lit(4), F.lit(30))).alias("a"), F.lit([list(j) for j in JUMPS]).alias("js")).select("a", F.explode("js").alias("j")).where("array_max(j) < a")
    out.append(jumps.select(F.lit("circulant").alias("family"), F.expr("concat(array(a, size(j)), j)").alias("key"), F.concat(F.lit("("), F.col("a"), F.lit(", "), F.expr(_tuple("j")), F.lit(")")).alias("params")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy("key")))
    return ranked.where(F.col("rank") <= count).select("family", "rank", "params")


def ngon(labels: DataFrame, radius: float = 1.0, phase: float = math.pi / 2) -> DataFrame:
    """labels(g, label) on a regular polygon by label order; a single one at the origin."""
    w = Window.partitionBy("g")
    k = F.row_number().over(w.orderBy("label")) - 1
    n = F.count("*").over(w)
    t = F.lit(phase) + F.lit(2 * math.pi) * k / n
    return labels.select("g", "label", F.when(n == 1, 0.0).otherwise(F.lit(radius) * F.cos(t)).alias("x"), F.when(n == 1, 0.0).otherwise(F.lit(radius) * F.sin(t)).alias("y"))


def column(labels: DataFrame, x: float = 0.0) -> DataFrame:
    """labels(g, label) on a vertical line, centred, one apart."""
    w = Window.partitionBy("g")
    k = F.row_number().over(w.orderBy("label")) - 1
    return labels.select("g", "label", F.lit(float(x)).alias("x"), ((F.count("*").over(w) - 1) / 2.0 - k).alias("y"))


def normalise(layout: DataFrame, radius: float = 1.0) -> DataFrame:
    """layout(g, label, x, y) centred on the middle of its box and scaled to 2 radius / max(extent, 1)."""
    w = Window.partitionBy("g")
    lo = lambda c: F.min(c).over(w)
    hi = lambda c: F.max(c).over(w)
    extent = F.greatest(hi("x") - lo("x"), hi("y") - lo("y"), F.lit(1.0))
    return layout.select("g", "label", *[((F.col(c) - (lo(c) + hi(c)) / 2) * (2 * radius) / extent).alias(c) for c in ("x", "y")])
