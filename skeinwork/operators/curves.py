"""Polylines (g, seq, x, y, z) in space: lengths, resampling, layout steps, energies and endpoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pieces(points: DataFrame) -> DataFrame:
    """(g, seg, x1..z2, len, s0) with lengths in space."""
    w = Window.partitionBy("g").orderBy("seq")
    rows = points.select("g", F.col("seq").alias("seg"), *[F.col(a).alias(f"{a}1") for a in "xyz"], *[F.lead(a).over(w).alias(f"{a}2") for a in "xyz"]).where("x2 IS NOT NULL")
    rows = rows.withColumn("len", F.sqrt(sum(((F.col(f"{a}2") - F.col(f"{a}1")) ** 2 for a in "xyz"), F.lit(0.0))))
    return rows.withColumn("s0", F.coalesce(F.sum("len").over(Window.partitionBy("g").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def at_lengths(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(g, k, s) with x, y, z at arc length s. Each place is matched with the piece it lies on by merging both in one
    ordered pass per curve, as an as-of join, so no interval join is needed."""
    p = pieces(points).where("len > 0")
    marks = p.select("g", F.col("s0").alias("s"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("k"), F.struct("s0", "len", *[f"{a}{i}" for a in "xyz" for i in (1, 2)]).alias("p"))
    asks = wanted.select("g", "s", F.lit(1).alias("kind"), "k", F.lit(None).cast(marks.schema["p"].dataType).alias("p"))
    w = Window.partitionBy("g").orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got = marks.unionByName(asks).withColumn("q", F.last("p", True).over(w)).where("kind = 1")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s") - F.col("q.s0")) / F.col("q.len")))
    return got.select("g", "k", "s", *[(F.col(f"q.{a}1") + t * (F.col(f"q.{a}2") - F.col(f"q.{a}1"))).alias(a) for a in "xyz"])


def resample(points: DataFrame, spacing: float) -> DataFrame:
    """(g, k, s, x, y, z): curves at equal steps near `spacing`, both ends kept, three points at least."""
    total = pieces(points).groupBy("g").agg(F.sum("len").alias("total"))
    n = F.greatest(F.lit(2), F.round(F.col("total") / spacing).cast("int"))
    wanted = total.select("g", n.alias("n"), "total", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    return at_lengths(points, wanted.select("g", F.col("k").cast("bigint").alias("k"), (F.col("total") * F.col("k") / F.col("n")).alias("s")))


def densify(points: DataFrame) -> DataFrame:
    """points with the middle of each piece added where a curve has only two points."""
    n = F.count("*").over(Window.partitionBy("g"))
    w = Window.partitionBy("g").orderBy("seq")
    rows = points.select("g", "seq", "x", "y", "z", n.alias("n"), *[F.lead(a).over(w).alias(f"n{a}") for a in "xyz"])
    mid = rows.where("n = 2 AND nx IS NOT NULL").select("g", (F.col("seq") * 2 + 1).alias("seq"), *[((F.col(a) + F.col(f"n{a}")) / 2).alias(a) for a in "xyz"])
    return rows.select("g", (F.col("seq") * 2).alias("seq"), "x", "y", "z").unionByName(mid)


def control_points(points: DataFrame, k: int) -> DataFrame:
    """(g, k, s, x, y, z): k interior points of each curve at equal fractions of its length."""
    total = pieces(points).groupBy("g").agg(F.sum("len").alias("total"))
    wanted = total.select("g", "total", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"))
    return at_lengths(points, wanted.select("g", F.col("k").cast("bigint").alias("k"), (F.col("total") * F.col("k") / (k + 1)).alias("s")))


def rest_lengths(points: DataFrame) -> DataFrame:
    """(g, rest, median): length per piece of each curve, and the median length of all curves."""
    total = pieces(points).groupBy("g").agg(F.sum("len").alias("total"), F.count("*").alias("n"))
    return total.join(total.agg(F.median("total").alias("median"))).select("g", (F.col("total") / F.col("n")).alias("rest"), "median")


def relax_step(particles: DataFrame, springs: DataFrame, repulsion: float, stiffness: float, dt: float) -> DataFrame:
    """particles(g, pid, x, y) after one step of pairwise repulsion k / d^2 and springs(a, b, rest) of force k ln(d / rest).
    All pairs of a diagram g act on each other, as the layout asks, and they are few; pids are told apart over all."""
    a, b = particles.alias("a"), particles.alias("b")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    d2 = dx * dx + dy * dy + 1e-6
    push = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.pid") != F.col("b.pid"))).select(F.col("a.pid").alias("pid"), (repulsion * dx / (d2 * F.sqrt(d2))).alias("fx"), (repulsion * dy / (d2 * F.sqrt(d2))).alias("fy"))
    both = springs.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q"), "rest"), F.struct(F.col("b").alias("p"), F.col("a").alias("q"), "rest"))).alias("s")).select("s.*")
    at = particles.select("pid", "x", "y")
    p, q = at.toDF("p", "px", "py"), at.toDF("q", "qx", "qy")
    ex, ey = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    d = F.sqrt(ex * ex + ey * ey + 1e-6)
    pull = both.join(p, "p").join(q, "q").select(F.col("p").alias("pid"), (stiffness * F.log(d / F.col("rest")) * ex / d).alias("fx"), (stiffness * F.log(d / F.col("rest")) * ey / d).alias("fy"))
    force = push.unionByName(pull).groupBy("pid").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    return particles.join(force, "pid", "left").select("g", "pid", (F.col("x") + dt * F.coalesce("fx", F.lit(0.0))).alias("x"), (F.col("y") + dt * F.coalesce("fy", F.lit(0.0))).alias("y"))


def tangents(points: DataFrame) -> DataFrame:
    """points with unit tangents tx, ty in the plane, by central differences along each curve."""
    w = Window.partitionBy("g").orderBy("seq")
    dx, dy = [F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a)) for a in "xy"]
    rows = points.withColumn("tx", dx).withColumn("ty", dy)
    n = F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2)
    return rows.withColumns({"tx": F.when(n > 0, F.col("tx") / n).otherwise(0.0), "ty": F.when(n > 0, F.col("ty") / n).otherwise(0.0)})


def tangent_repulsion(points: DataFrame, k: float) -> DataFrame:
    """(d, g, seq, fx, fy): forces k / (perp^2 d^2) between points of different curves g of one diagram d, perp the distance
    from the other's tangent line. points: (d, g, seq, x, y)."""
    rows = tangents(points).select("d", "g", "seq", "x", "y", "tx", "ty")
    a, b = rows.alias("a"), rows.alias("b")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    perp = dx * F.col("b.ty") - dy * F.col("b.tx")
    d2 = dx * dx + dy * dy + 1e-6
    f = k / ((perp * perp + 1e-6) * d2)
    return a.join(b, (F.col("a.d") == F.col("b.d")) & (F.col("a.g") != F.col("b.g"))).groupBy(F.col("a.d").alias("d"), F.col("a.g").alias("g"), F.col("a.seq").alias("seq")).agg(F.sum(f * dx / F.sqrt(d2)).alias("fx"), F.sum(f * dy / F.sqrt(d2)).alias("fy"))


def bezier(arcs: DataFrame, steps: int = 10, reach: float = 0.35) -> DataFrame:
    """(aid, k, x, y) on the cubic of arcs(aid, x1, y1, a1, x2, y2, a2): controls lie reach times the chord along the end
    directions a1 and a2."""
    chord = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2) * reach
    rows = arcs.select("*", chord.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    t = F.col("k") / F.lit(float(steps))
    u = 1 - t
    out = []
    for a, f in (("x", F.cos), ("y", F.sin)):
        p1, p2 = F.col(f"{a}1"), F.col(f"{a}2")
        out.append((u * u * u * p1 + 3 * u * u * t * (p1 + F.col("c") * f("a1")) + 3 * u * t * t * (p2 + F.col("c") * f("a2")) + t * t * t * p2).alias(a))
    return rows.select("aid", F.col("k").cast("bigint").alias("k"), *out)


def length_energy(points: DataFrame, target: Column) -> DataFrame:
    """(g, energy): squared deviation of each curve's length from a target."""
    return pieces(points).groupBy("g").agg(F.sum("len").alias("total")).select("g", ((F.col("total") - target) ** 2).alias("energy"))


def bending_energy(points: DataFrame) -> DataFrame:
    """(g, energy): squared second differences."""
    w = Window.partitionBy("g").orderBy("seq")
    second = sum(((F.lead(a).over(w) - 2 * F.col(a) + F.lag(a).over(w)) ** 2 for a in "xyz"), F.lit(0.0))
    return points.select("g", second.alias("b")).groupBy("g").agg(F.sum("b").alias("energy"))


def tangent_point_energy(points: DataFrame, alpha: float = 2.0, beta: float = 4.0, near: int = 1) -> DataFrame:
    """(g, energy): for pieces of one curve further than `near` apart, |perp|^alpha / d^beta over both, with middles, unit
    tangents and lengths."""
    p = pieces(points).where("len > 0")
    rows = p.select("g", "seg", "len", *[((F.col(f"{a}1") + F.col(f"{a}2")) / 2).alias(f"m{a}") for a in "xyz"], *[((F.col(f"{a}2") - F.col(f"{a}1")) / F.col("len")).alias(f"t{a}") for a in "xyz"])
    a, b = rows.alias("a"), rows.alias("b")
    d = {k: F.col(f"b.m{k}") - F.col(f"a.m{k}") for k in "xyz"}
    d2 = d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2 + 1e-9
    along = d["x"] * F.col("a.tx") + d["y"] * F.col("a.ty") + d["z"] * F.col("a.tz")
    perp2 = F.greatest(F.lit(0.0), d2 - along * along)
    e = F.pow(perp2, F.lit(alpha / 2)) / F.pow(d2, F.lit(beta / 2)) * F.col("a.len") * F.col("b.len")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.abs(F.col("a.seg") - F.col("b.seg")) > near))
    return met.groupBy(F.col("a.g").alias("g")).agg(F.sum(e).alias("energy"))


def glue_endpoints(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points with the ends of curves moved to their nodes' means; nodes(g, tip, node): tip 0 for the first point."""
    w = Window.partitionBy("g")
    rows = points.withColumn("tip", F.when(F.col("seq") == F.min("seq").over(w), 0).when(F.col("seq") == F.max("seq").over(w), 1))
    ends = rows.join(nodes, ["g", "tip"])
    mean = ends.groupBy("node").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    moved = nodes.join(mean, "node").select("g", "tip", "mx", "my", "mz")
    return rows.join(moved, ["g", "tip"], "left").select("g", "seq", *[F.coalesce(f"m{a}", a).alias(a) for a in "xyz"])


def replace_endpoint(points: DataFrame, moves: DataFrame) -> DataFrame:
    """points with one end of each moved curve put elsewhere: the end that is closer to the old place, the first if both
    are. moves: (g, ox, oy, oz, nx, ny, nz)."""
    w = Window.partitionBy("g")
    rows = points.join(moves, "g", "left")
    far = F.sqrt(sum(((F.col(a) - F.col(f"o{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    rows = rows.withColumns({"first": F.min("seq").over(w), "last": F.max("seq").over(w), "far": far})
    at = lambda k: F.max(F.when(F.col("seq") == F.col(k), F.col("far"))).over(w)
    rows = rows.withColumn("goes", F.when(at("first") <= at("last"), F.col("first")).otherwise(F.col("last")))
    moved = F.col("nx").isNotNull() & (F.col("seq") == F.col("goes"))
    return rows.select("g", "seq", *[F.when(moved, F.col(f"n{a}")).otherwise(F.col(a)).alias(a) for a in "xyz"])


def tubes(points: DataFrame, radius: float, sides: int = 8) -> DataFrame:
    """(g, seq, side, x, y, z): rings of `sides` points around each curve's points, across its direction by central
    differences; the table a drawing of tubes is made of."""
    w = Window.partitionBy("g").orderBy("seq")
    d = {a: F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a)) for a in "xyz"}
    rows = points.withColumns({f"d{a}": v for a, v in d.items()})
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    rows = rows.where(n > 0).withColumns({f"d{a}": F.col(f"d{a}") / n for a in "xyz"})
    # a first normal: the direction crossed with the axis that it is furthest from
    flat = F.abs("dz") < 0.9
    ux, uy, uz = F.when(flat, F.col("dy")).otherwise(0.0), F.when(flat, -F.col("dx")).otherwise(F.col("dz")), F.when(flat, 0.0).otherwise(-F.col("dy"))
    rows = rows.withColumns({"ux": ux, "uy": uy, "uz": uz})
    m = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    rows = rows.withColumns({f"u{a}": F.col(f"u{a}") / m for a in "xyz"})
    cross = {"x": "dy * uz - dz * uy", "y": "dz * ux - dx * uz", "z": "dx * uy - dy * ux"}
    rows = rows.withColumns({f"v{a}": F.expr(e) for a, e in cross.items()}).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    t = F.col("side") * (2 * math.pi / sides)
    return rows.select("g", "seq", "side", *[(F.col(a) + radius * (F.cos(t) * F.col(f"u{a}") + F.sin(t) * F.col(f"v{a}"))).alias(a) for a in "xyz"])


def tube_triangles(rings: DataFrame, sides: int = 8) -> DataFrame:
    """(g, seq, side, half, a, b, c): the triangles between a ring and the next, two a side; corners are numbered
    place * sides + side, place counting a curve's rings from 0."""
    w = Window.partitionBy("g").orderBy("seq")
    rows = rings.select("g", "seq").distinct().select("g", "seq", (F.row_number().over(w) - 1).alias("place"), F.lead("seq").over(w).alias("next")).where("next IS NOT NULL")
    rows = rows.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    here, there, turn = F.col("place") * sides, (F.col("place") + 1) * sides, (F.col("side") + 1) % sides
    one = F.struct(F.lit(0).alias("half"), (here + F.col("side")).alias("a"), (here + turn).alias("b"), (there + F.col("side")).alias("c"))
    two = F.struct(F.lit(1).alias("half"), (here + turn).alias("a"), (there + turn).alias("b"), (there + F.col("side")).alias("c"))
    return rows.select("g", "seq", "side", F.explode(F.array(one, two)).alias("t")).select("g", "seq", "side", "t.*")


def recenter(points: DataFrame) -> DataFrame:
    """points less the mean of their curve."""
    w = Window.partitionBy("g")
    return points.select("g", "seq", *[(F.col(a) - F.avg(a).over(w)).alias(a) for a in "xyz"])


def closure_point(points: DataFrame, direction: tuple[float, float, float], scale: float = 2.0) -> DataFrame:
    """(g, x, y, z): a point outside each curve, from its mean along a unit direction, scale times the largest radius."""
    n = math.sqrt(sum(v * v for v in direction))
    mean = points.groupBy("g").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    far = points.join(mean, "g").groupBy("g", "mx", "my", "mz").agg(F.max(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 + (F.col("z") - F.col("mz")) ** 2)).alias("r"))
    return far.select("g", *[(F.col(f"m{a}") + F.col("r") * (scale * v / n)).alias(a) for a, v in zip("xyz", direction)])


def hermite(p0: Column, p1: Column, m0: Column, m1: Column, t: Column) -> Column:
    """Cubic Hermite blend of values and slopes."""
    return (2 * t * t * t - 3 * t * t + 1) * p0 + (t * t * t - 2 * t * t + t) * m0 + (3 * t * t - 2 * t * t * t) * p1 + (t * t * t - t * t) * m1
