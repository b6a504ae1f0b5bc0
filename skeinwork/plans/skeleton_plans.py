"""Queries of skeletons and of the stream, with their DuckDB twins where there are any."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fields, skeleton, surfaces, thinning
from ..streaming import consensus
from ..operators.connected import components
from .common import cut, shared_dir
from .curve_plans import P3
from .field_plans import N, components_sql, hopf, interior_sql, steps
from .geometry_plans import PTS, curves, r6


def mask(spark, n=N):
    return fields.interior(*hopf(spark, n)).select(F.lit(0).cast("bigint").alias("grid_id"), "ix", "iy", "iz")


def _coords(spark, d):
    got = thinning.thin(mask(spark), cut)
    return fields.to_coordinates(got.select("ix", "iy", "iz"), steps(N, ((-1, 1),) * 3), (0.0, 0.0, 0.0))


def _graph(short):
    def run(spark, d):
        got = skeleton.skeleton_graph(mask(spark, 32), epsilon=0.5, short=short)
        return got.groupBy("grid_id", "eid", "u", "v").agg(F.count("*").alias("points"))

    return run


def _stream(spark, d):
    return consensus.agreed(consensus.drain(consensus.event_tries(spark, d), f"{shared_dir(spark)}/consensus-{uuid.uuid4().hex}"), 3)


def _topology(spark, d):
    """Thinning keeps the number of parts and the Euler characteristic, and a part of the mask: those of the skeleton are
    compared with those of the mask."""
    m = cut(mask(spark))
    thin = cut(thinning.thin(m, cut).select("ix", "iy", "iz"))
    place = lambda p: ((F.col(f"{p}x") * 1000 + F.col(f"{p}y")) * 1000 + F.col(f"{p}z")).cast("bigint")
    joined = components(fields.neighbours(thin).select(place("i").alias("u"), place("j").alias("v")), cut)
    parts = thin.select(place("i").alias("v")).join(joined, "v", "left").select(F.coalesce("component", "v").alias("c")).agg(F.countDistinct("c").alias("parts"))
    inside = thin.join(m, ["ix", "iy", "iz"], "left_anti").agg((F.count("*") == 0).alias("inside"))
    return fields.euler(thin).select("euler").join(parts).join(inside)


TOPOLOGY = components_sql().split(" SELECT component")[0] + """, o AS (SELECT unnest(range(3)) v), cu AS (SELECT DISTINCT 2 * ix + a.v x, 2 * iy + b.v y, 2 * iz + c.v z FROM m, o a, o b, o c)
SELECT (SELECT CAST(sum(CASE WHEN (x % 2 + y % 2 + z % 2) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) FROM cu) AS euler, (SELECT count(DISTINCT component) FROM c) AS parts, true AS inside"""


#: Voxels of a unit of length.
FINE = 128
_BALL = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if a * a + b * b + c * c <= 5]


def tubes(spark, d):
    """A mask for each label: all voxels near its embedding curve, taken in steps of a voxel at most. Pieces of curves are
    dealt to all tasks, as they become many voxels, and these by cubes, so that balls that overlap are made in one task."""
    p = curves(spark, d)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("g").orderBy("seq")
    piece = p.select("g", *"xyz", *[F.lead(a).over(w).alias(f"{a}2") for a in "xyz"]).where("x2 IS NOT NULL")
    far = F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y")) + (F.col("z2") - F.col("z")) * (F.col("z2") - F.col("z")))
    piece = piece.repartition(tasks, "g", "seq").withColumn("n", F.ceil(far * FINE).cast("bigint") + 1).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))))
    at = [F.floor((F.col(a) + (F.col(f"{a}2") - F.col(a)) * F.col("k") / F.col("n") + 2) * FINE).cast("bigint").alias(f"i{a}") for a in "xyz"]
    centres = piece.select(F.col("g").alias("grid_id"), *at).select("*", *[F.shiftright(f"i{a}", 5).alias(f"c{a}") for a in "xyz"])
    centres = centres.repartition(tasks, "grid_id", "cx", "cy", "cz").distinct()
    ball = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip("xyz", o)]) for o in _BALL])
    return centres.withColumn("o", F.explode(ball)).select("grid_id", *[(F.col(f"i{a}") + F.col(f"o.{a}")).alias(f"i{a}") for a in "xyz"]).distinct()


def _thin_tubes(spark, d):
    """Voxels before and after thinning, and the Euler characteristic of what is left, which is that of the mask."""
    m = cut(tubes(spark, d))
    thin = cut(thinning.thin(m, cut))
    counts = m.groupBy("grid_id").agg(F.count("*").alias("voxels"))
    fewer = thin.groupBy("grid_id").agg((F.count("*") * 4).alias("n"))
    return counts.join(fewer, "grid_id").join(thinning.euler(thin), "grid_id").select("grid_id", "voxels", (F.col("n") < F.col("voxels")).alias("thin"), "euler")


THIN_TUBES = f"""WITH {PTS}, pi AS (SELECT * FROM (SELECT g, x, y, z, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2 FROM pts WINDOW w AS (PARTITION BY g ORDER BY seq)) WHERE x2 IS NOT NULL),
st AS (SELECT *, unnest(range(n + 1)) k FROM (SELECT *, CAST(ceil(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)) * {FINE}) AS BIGINT) + 1 AS n FROM pi)),
ce AS (SELECT DISTINCT g, {', '.join(f'CAST(floor(({a} + ({a}2 - {a}) * k / n + 2) * {FINE}) AS BIGINT) i{a}' for a in 'xyz')} FROM st), ba AS (SELECT * FROM (VALUES {', '.join(map(str, _BALL))}) t(a, b, c)),
m AS (SELECT DISTINCT g, ix + a ix, iy + b iy, iz + c iz FROM ce, ba), o AS (SELECT unnest(range(3)) v), cu AS (SELECT DISTINCT g, 2 * ix + a.v x, 2 * iy + b.v y, 2 * iz + c.v z FROM m, o a, o b, o c),
e AS (SELECT g, CAST(sum(CASE WHEN (x + y + z) % 2 = 1 THEN -1 ELSE 1 END) AS BIGINT) euler FROM cu GROUP BY g) SELECT g AS grid_id, voxels, true AS thin, euler FROM (SELECT g, count(*) voxels FROM m GROUP BY g) v JOIN e USING (g)"""


def _trace_tubes(spark, d):
    """The graph of every tube's medial curves: nodes, edges with their points, and the longest edge."""
    nodes, points = thinning.trace(cut(thinning.thin(tubes(spark, d), cut)), cut)
    edges = points.groupBy("grid_id", "edge", "u", "v").agg(F.count("*").alias("points"))
    drawn = edges.groupBy("grid_id").agg(F.count("*").alias("edges"), F.sum("points").alias("points"), F.max("points").alias("longest"))
    return nodes.groupBy("grid_id").agg(F.count("*").alias("nodes")).join(drawn, "grid_id", "left")


def density(spark, d):
    """Vectors of each label, in three dimensions, dealt to the points of a grid of their own."""
    return surfaces.splat(curves(spark, d).select(F.col("g").alias("grid_id"), "x", "y", "z"), 16.0)


def _surface(spark, d):
    """Closed surfaces around where vectors are dense."""
    got = surfaces.summary(surfaces.mesh(density(spark, d), 0.5))
    return got.select("grid_id", "corners", "triangles", "closed", "euler")


def surface_sql():
    at, dirs = surfaces.CORNERS, range(1, 8)
    way = ", ".join(f"({s * at[k][0]}, {s * at[k][1]}, {s * at[k][2]})" for k in dirs for s in (1, -1))
    of = ", ".join(f"({n}, {', '.join(str(v) for v in at[c])})" for n, t in enumerate(surfaces.TETRAHEDRA) for c in t)
    chains = sorted({tuple(c for i, c in enumerate(t) if m >> i & 1) for t in surfaces.TETRAHEDRA for m in range(1, 16, 2)})
    parts = ", ".join(f"({n}, {len(c)}, {', '.join(str(v) for v in at[k])})" for n, c in enumerate(chains) for k in c)
    w = lambda a: f"CASE WHEN o.{a} = 1 THEN {a} - floor({a}) ELSE 1 - ({a} - floor({a})) END"
    return f"""WITH {PTS}, q AS (SELECT g, x * 16 AS px, y * 16 AS py, z * 16 AS pz FROM pts), two AS (SELECT unnest(range(2)) v), o AS (SELECT a.v px, b.v py, c.v pz FROM two a, two b, two c),
sp AS (SELECT g, CAST(floor(q.px) AS BIGINT) + o.px ix, CAST(floor(q.py) AS BIGINT) + o.py iy, CAST(floor(q.pz) AS BIGINT) + o.pz iz, {' * '.join('(' + w(a).replace(f"{a} - floor({a})", f"q.{a} - floor(q.{a})") + ')' for a in ('px', 'py', 'pz'))} w FROM q, o),
n AS (SELECT g, ix, iy, iz FROM sp GROUP BY ALL HAVING round(sum(w), 9) > 0.5), wy AS (SELECT * FROM (VALUES {way}) t(a, b, c)), tt AS (SELECT * FROM (VALUES {of}) t(t, a, b, c)), ch AS (SELECT * FROM (VALUES {parts}) t(s, k, a, b, c)),
co AS (SELECT n.g, count(*) corners FROM n CROSS JOIN wy LEFT JOIN n m ON m.g = n.g AND m.ix = n.ix + a AND m.iy = n.iy + b AND m.iz = n.iz + c WHERE m.g IS NULL GROUP BY n.g),
tr AS (SELECT g, CAST(sum(CASE WHEN k = 2 THEN 2 WHEN k = 4 THEN 0 ELSE 1 END) AS BIGINT) triangles FROM (SELECT g, t, ix - a, iy - b, iz - c, count(*) k FROM n, tt GROUP BY ALL) GROUP BY g),
si AS (SELECT n.g, n.ix, n.iy, n.iz, s, k FROM n CROSS JOIN ch JOIN n m ON m.g = n.g AND m.ix = n.ix + a AND m.iy = n.iy + b AND m.iz = n.iz + c GROUP BY ALL HAVING count(*) = k), eu AS (SELECT g, CAST(2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) euler FROM si GROUP BY g)
SELECT co.g AS grid_id, corners, triangles, true AS closed, euler FROM co JOIN tr ON tr.g = co.g JOIN eu ON eu.g = co.g"""


def _windows(spark, d):
    """Windows of the event stream, run until the source is empty."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = consensus.settle(consensus.windows(events), f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def _smooth(spark, d):
    got = skeleton.smooth(curves(spark, d), 0.2)
    return got.select("g", "seq", *[r6(F.col(a), a) for a in "xyz"])


def _repel(spark, d):
    """The energy before, to five digits, and whether less of it is left and the ends are where they were."""
    got = skeleton.repel(curves(spark, d), 60)
    at = curves(spark, d).select("g", "seq", F.struct("x", "y", "z").alias("from"))
    n = F.max("seq").over(Window.partitionBy("g"))
    rows = got.join(at, ["g", "seq"]).withColumn("end", (F.col("seq") == 0) | (F.col("seq") == n))
    return rows.groupBy("g").agg(F.count("*").alias("points"), F.format_string("%.4e", F.max("before")).alias("before"), (F.max("after") < F.max("before")).alias("lower"), F.max(F.when(F.col("end"), F.struct("x", "y", "z") != F.col("from"))).alias("moved_ends"))


# pieces have their rest lengths at first, so the energy is that of tangents and points and of bending
REPEL = f"""WITH {P3}, m AS (SELECT g, seg, len, (x1 + x2) / 2 mx, (y1 + y2) / 2 my, (z1 + z2) / 2 mz, (x2 - x1) / len tx, (y2 - y1) / len ty, (z2 - z1) / len tz FROM pc WHERE len > 0),
q AS (SELECT a.g, a.len * b.len ll, (b.mx - a.mx) ** 2 + (b.my - a.my) ** 2 + (b.mz - a.mz) ** 2 + 1e-9 d2, (b.mx - a.mx) * a.tx + (b.my - a.my) * a.ty + (b.mz - a.mz) * a.tz al FROM m a JOIN m b ON a.g = b.g AND abs(a.seg - b.seg) > 1),
e AS (SELECT g, sum(greatest(0.0, d2 - al * al) / (d2 * d2) * ll) e FROM q GROUP BY g), b AS (SELECT g, (lead(x) OVER w - 2 * x + lag(x) OVER w) ** 2 + (lead(y) OVER w - 2 * y + lag(y) OVER w) ** 2 + (lead(z) OVER w - 2 * z + lag(z) OVER w) ** 2 b FROM pts WINDOW w AS (PARTITION BY g ORDER BY seq)), c AS (SELECT g, sum(b) b, count(*) n FROM b GROUP BY g)
SELECT g, n AS points, printf('%.4e', e + 0.05 * b) AS before, true AS lower, false AS moved_ends FROM e JOIN c USING (g)"""


def plans():
    pts = f"WITH {PTS} SELECT g, count(*) AS points FROM pts GROUP BY g"
    voxel = interior_sql(N) + " SELECT a.ix AS ix, a.iy AS iy, a.iz AS iz, count(b.ix) - 1 AS degree FROM m a JOIN m b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 GROUP BY 1, 2, 3"
    return {
        "edge_point_count": (lambda s, d: curves(s, d).groupBy("g").agg(F.count("*").alias("points")), pts),
        "voxel_graph": (lambda s, d: skeleton.voxel_degrees(mask(s)), voxel),
        "skeletonize": (lambda s, d: thinning.thin(mask(s), cut), None),
        "thin_tubes": (_thin_tubes, THIN_TUBES),
        "trace_tubes": (_trace_tubes, None),
        "surface_mesh": (_surface, surface_sql()),
        "skeleton_topology": (_topology, TOPOLOGY),
        "skeleton_coords": (_coords, None),
        "skeleton_graph": (_graph(0.0), None),
        "skeleton_graph_mb": (_graph(2.0), None),
        "contract_short": (_graph(4.0), None),
        "smooth_rdp": (_smooth, None),
        "repel": (_repel, REPEL),
        "stream_consensus": (_stream, "SELECT g, count(*) AS polys FROM (SELECT CAST(user_id % 50 AS BIGINT) g, event_type || ':' || (event_id % 3) poly, count(*) n FROM events GROUP BY ALL HAVING count(*) >= 3) GROUP BY g"),
        "event_windows": (_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    }


