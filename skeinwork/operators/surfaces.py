"""Closed triangle meshes at a level of scalar fields, by tetrahedra, in DataFrame functions.

Every cube of the grid is six tetrahedra around its main diagonal, the same way in all cubes, so faces match. A tetrahedron
whose corners lie on both sides of the level has a triangle or two; their corners are on its edges and are named by these,
so neighbouring tetrahedra share them without any search. Which triangles a cube has follows from the sides of its eight
corners: that table of 256 cases is made by rule, and joined.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corners of a cube, by bits x, y, z.
CORNERS = [(k & 1, k >> 1 & 1, k >> 2 & 1) for k in range(8)]
TETRAHEDRA = [(0, 1 << p[0], (1 << p[0]) + (1 << p[1]), 7) for p in permutations(range(3))]


def triangles_of(mask: int) -> list[tuple[tuple[int, int], ...]]:
    """Triangles of a cube whose inside corners are the bits of mask: three edges each, as (from, to) corners, counter-clockwise
    as seen from outside."""
    out = []
    for corners in TETRAHEDRA:
        inside = [c for c in corners if mask >> c & 1]
        outside = [c for c in corners if not mask >> c & 1]
        if not inside or not outside:
            continue
        if len(inside) == 2:
            (a, b), (c, d) = inside, outside
            found = [((a, c), (a, d), (b, d)), ((a, c), (b, d), (b, c))]
        else:
            found = [tuple((i, o) for i in inside for o in outside)]
        at = lambda c: np.array(CORNERS[c], float)
        way = np.mean([at(c) for c in outside], 0) - np.mean([at(c) for c in inside], 0)
        for edges in found:
            p, q, r = ((at(i) + at(o)) / 2 for i, o in edges)
            if np.cross(q - p, r - p) @ way < 0:
                edges = edges[::-1]
            out.append(tuple((min(e), max(e)) for e in edges))
    return out


def cases(spark: SparkSession) -> DataFrame:
    """(mask, n, a1, b1, a2, b2, a3, b3): the triangles of all cases; 1,600 rows or so."""
    rows = [(m, n, *[c for e in t for c in e]) for m in range(256) for n, t in enumerate(triangles_of(m))]
    return spark.createDataFrame(rows, "mask int, n int, a1 int, b1 int, a2 int, b2 int, a3 int, b3 int")


def mesh(field: DataFrame, level: float, outside: float = 0.0) -> DataFrame:
    """(grid_id, c1, c2, c3): triangles of the surface where field(grid_id, ix, iy, iz, value) passes the level, each corner a
    struct (ix, iy, iz, way, x, y, z): the edge it lies on, from a grid point to the one `way` (1 to 7, by bits) further, and
    its place in index units. Grid points that aren't in the field have the value `outside`, and are outside where that is no
    more than the level, so the surface is closed. Points at the level are outside."""
    spark = field.sparkSession
    points = field.select("grid_id", "ix", "iy", "iz", F.col("value").cast("double").alias("value"))
    around = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", c)], F.lit(i).alias("corner")) for i, c in enumerate(CORNERS)])
    held = points.withColumn("o", F.explode(around)).select("grid_id", *[(F.col(f"i{k}") - F.col(f"o.{n}")).alias(f"i{k}") for k, n in zip("xyz", "abc")], "o.corner", "value")
    value = [F.coalesce(F.max(F.when(F.col("corner") == i, F.col("value"))), F.lit(outside)) for i in range(8)]
    cubes = held.groupBy("grid_id", "ix", "iy", "iz").agg(F.array(*value).alias("v"))
    mask = sum((F.when(F.col("v")[i] > level, 1 << i).otherwise(0) for i in range(8)), F.lit(0))
    cubes = cubes.withColumn("mask", mask).where("mask BETWEEN 1 AND 254")
    found = cubes.join(F.broadcast(cases(spark)), "mask")

    def corner(k: int) -> Column:
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1))
        at = [F.col(f"i{x}") + bit(a, i) for i, x in enumerate("xyz")]
        low, high = F.get("v", a), F.get("v", b)
        t = (F.lit(level) - low) / (high - low)
        return F.struct(*[c.cast("long").alias(f"i{x}") for c, x in zip(at, "xyz")], (b - a).alias("way"), *[(c + t * bit(b - a, i)).alias(x) for i, (c, x) in enumerate(zip(at, "xyz"))])

    return found.select("grid_id", *[corner(k).alias(f"c{k}") for k in (1, 2, 3)])


def _name(c: str) -> Column:
    return F.struct(*[F.col(f"{c}.{k}").alias(k) for k in ("ix", "iy", "iz", "way")])


def summary(triangles: DataFrame) -> DataFrame:
    """(grid_id, corners, edges, triangles, closed, euler, area, volume): closed where every edge has a triangle on either
    side, each going another way along it; the volume inside is that of the cones from the origin, with their signs."""
    t = triangles.select("grid_id", *[_name(c).alias(f"n{c[1]}") for c in ("c1", "c2", "c3")], *[F.col(f"c{k}.{x}").alias(f"{x}{k}") for k in (1, 2, 3) for x in "xyz"])
    u = [F.col(f"{x}2") - F.col(f"{x}1") for x in "xyz"]
    v = [F.col(f"{x}3") - F.col(f"{x}1") for x in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    sizes = t.groupBy("grid_id").agg(F.count("*").alias("triangles"), F.sum(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2).alias("area"), F.sum((F.col("x1") * n[0] + F.col("y1") * n[1] + F.col("z1") * n[2]) / 6).alias("volume"))
    corners = t.select("grid_id", F.explode(F.array("n1", "n2", "n3")).alias("n")).distinct().groupBy("grid_id").agg(F.count("*").alias("corners"))
    side = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(F.col(a) < F.col(b), 1).otherwise(-1).alias("way"))
    sides = t.select("grid_id", F.explode(F.array(side("n1", "n2"), side("n2", "n3"), side("n3", "n1"))).alias("e")).groupBy("grid_id", "e.a", "e.b").agg(F.count("*").alias("n"), F.sum("e.way").alias("way"))
    edges = sides.groupBy("grid_id").agg(F.count("*").alias("edges"), F.min((F.col("n") == 2) & (F.col("way") == 0)).alias("closed"))
    return sizes.join(corners, "grid_id").join(edges, "grid_id").select("grid_id", "corners", "edges", "triangles", "closed", (F.col("corners") - F.col("edges") + F.col("triangles")).alias("euler"), "area", "volume")


def splat(points: DataFrame, scale: float) -> DataFrame:
    """(grid_id, ix, iy, iz, value): points(grid_id, x, y, z) dealt to the eight grid points around each, by trilinear weights,
    and added up."""
    around = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", c)]) for c in CORNERS])
    rows = points.select("grid_id", *[(F.col(k) * scale).alias(k) for k in "xyz"], F.explode(around).alias("o"))
    for k, n in zip("xyz", "abc"):
        low = F.floor(k)
        rows = rows.withColumn(f"i{k}", low + F.col(f"o.{n}")).withColumn(f"w{k}", F.when(F.col(f"o.{n}") == 1, F.col(k) - low).otherwise(1 - (F.col(k) - low)))
    return rows.groupBy("grid_id", "ix", "iy", "iz").agg(F.round(F.sum(F.col("wx") * F.col("wy") * F.col("wz")), 9).alias("value"))
