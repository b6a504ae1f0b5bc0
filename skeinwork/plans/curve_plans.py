"""Queries of curves, layout steps, energies, proteins and slabs, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves as cv
from ..operators import slab
from ..sources import pdb
from .geometry_plans import PTS, chain, curves, r6

P3 = f"""{PTS}, p0 AS (SELECT g, seq AS seg, x x1, y y1, z z1, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2 FROM pts WINDOW w AS (PARTITION BY g ORDER BY seq)),
p1 AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2 + (z2 - z1) ** 2) len FROM p0 WHERE x2 IS NOT NULL),
pc AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY g ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) s0 FROM p1), tl AS (SELECT g, sum(len) total, count(*) n FROM pc GROUP BY g)"""


def asof(wanted):
    return f"WITH {P3}, wt AS ({wanted}), hit AS (SELECT wt.g, k, s, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (s - s0) / len)) t, x1, x2, y1, y2, z1, z2 FROM wt ASOF JOIN pc ON wt.g = pc.g AND wt.s >= pc.s0) SELECT g, k, round(x1 + t * (x2 - x1), 6) + 0.0 AS x, round(y1 + t * (y2 - y1), 6) + 0.0 AS y, round(z1 + t * (z2 - z1), 6) + 0.0 AS z FROM hit"


def xyz(df, *keys):
    return df.select(*keys, *[r6(F.col(a), a) for a in "xyz"])


def groups(spark, d, size):
    """Short curves that take up all vectors: `size` of them after one another make a curve g."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("i"), F.slice("embedding", 1, 3).alias("e"))
    return e.select(F.floor(F.col("i") / size).alias("g"), (F.col("i") % size).alias("seq"), *[F.col("e")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def groups_sql(size):
    return f"p AS (SELECT CAST(vec_id AS BIGINT) // {size} g, CAST(vec_id AS BIGINT) % {size} seq, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings)"


def diagrams(spark, d):
    """(particles, springs): curves of six points as diagrams of their own."""
    p = groups(spark, d, 6)
    springs = p.select((F.col("g") * 6 + F.col("seq")).alias("a"), (F.col("g") * 6 + F.col("seq") + 1).alias("b"), F.lit(0.5).alias("rest"), "g", "seq")
    return p.select("g", (F.col("g") * 6 + F.col("seq")).alias("pid"), "x", "y"), springs.where("seq < 5").select("g", "a", "b", "rest")


def _relax(spark, d):
    p, s = diagrams(spark, d)
    return cv.relax_step(p, s.drop("g"), 0.01, 0.1, 0.05).select("pid", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


RELAX = f"""WITH {groups_sql(6)}, q AS (SELECT g, g * 6 + seq pid, x, y FROM p), ps AS (SELECT a.pid, 0.01::DOUBLE * (a.x - b.x) / (d2 * sqrt(d2)) fx, 0.01::DOUBLE * (a.y - b.y) / (d2 * sqrt(d2)) fy FROM (SELECT a, b, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 1e-6 d2 FROM q a JOIN q b ON a.g = b.g AND a.pid <> b.pid)),
sp AS (SELECT a.pid p, b.pid q, a.x px, a.y py, b.x qx, b.y qy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + 1e-6) d FROM q a JOIN q b ON a.g = b.g AND abs(a.pid - b.pid) = 1),
f AS (SELECT pid, sum(fx) fx, sum(fy) fy FROM (SELECT * FROM ps UNION ALL SELECT p, 0.1::DOUBLE * ln(d / 0.5) * (qx - px) / d, 0.1::DOUBLE * ln(d / 0.5) * (qy - py) / d FROM sp) GROUP BY pid) SELECT pid, round(x + 0.05::DOUBLE * fx, 6) + 0.0 AS x, round(y + 0.05::DOUBLE * fy, 6) + 0.0 AS y FROM q JOIN f USING (pid)"""


def _tangent(spark, d):
    p = groups(spark, d, 6).select(F.floor(F.col("g") / 5).alias("d"), "g", "seq", "x", "y")
    return cv.tangent_repulsion(p, 0.001).select("g", "seq", (F.round("fx", 4) + 0.0).alias("fx"), (F.round("fy", 4) + 0.0).alias("fy"))


TANGENT = f"""WITH {groups_sql(6)}, t0 AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) ax, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) ay FROM p WINDOW w AS (PARTITION BY g ORDER BY seq)),
t AS (SELECT g, seq, x, y, ax / sqrt(ax * ax + ay * ay) tx, ay / sqrt(ax * ax + ay * ay) ty FROM t0), m AS (SELECT a.g, a.seq, a.x - b.x dx, a.y - b.y dy, b.tx, b.ty FROM t a JOIN t b ON a.g // 5 = b.g // 5 AND a.g <> b.g), n AS (SELECT *, dx * dx + dy * dy + 1e-6 d2, (dx * ty - dy * tx) ** 2 + 1e-6 p2 FROM m)
SELECT g, seq, round(sum(0.001::DOUBLE / (p2 * d2) * dx / sqrt(d2)), 4) + 0.0 AS fx, round(sum(0.001::DOUBLE / (p2 * d2) * dy / sqrt(d2)), 4) + 0.0 AS fy FROM n GROUP BY g, seq"""


def _bezier(spark, d):
    """A cubic from every point of a curve to the next."""
    w = Window.partitionBy("g").orderBy("seq")
    arcs = curves(spark, d).select((F.col("g") * 10**6 + F.col("seq")).alias("aid"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("a1"), *[F.lead(c).over(w).alias(n) for c, n in (("x", "x2"), ("y", "y2"), ("z", "a2"))])
    return cv.bezier(arcs.where("x2 IS NOT NULL")).select("aid", "k", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


def bez(a, f):
    return f"round((1 - t) ** 3 * {a}1 + 3 * (1 - t) ** 2 * t * ({a}1 + c * {f}(a1)) + 3 * (1 - t) * t ** 2 * ({a}2 + c * {f}(a2)) + t ** 3 * {a}2, 6) + 0.0 AS {a}"


BEZIER = f"WITH {PTS}, e AS (SELECT p.g * 1000000 + p.seq aid, p.x x1, p.y y1, p.z a1, q.x x2, q.y y2, q.z a2, 0.35 * sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) c FROM pts p JOIN pts q ON p.g = q.g AND q.seq = p.seq + 1), k AS (SELECT *, unnest(range(11)) k FROM e), t AS (SELECT *, k / 10.0::DOUBLE t FROM k) SELECT aid, k, {bez('x', 'cos')}, {bez('y', 'sin')} FROM t"


def _glue(spark, d):
    p = groups(spark, d, 6)
    nodes = p.select("g").distinct().select("g", F.explode(F.array(F.struct(F.lit(0).alias("tip"), (F.col("g") % 3).alias("node")), F.struct(F.lit(1).alias("tip"), (F.col("g") % 3 + 10).alias("node")))).alias("t")).select("g", "t.*")
    return xyz(cv.glue_endpoints(p, nodes), "g", "seq")


GLUE = f"WITH {groups_sql(6).replace('p AS', 'p0 AS')}, p AS (SELECT *, CASE WHEN seq = 0 THEN g % 3 WHEN seq = max(seq) OVER (PARTITION BY g) THEN g % 3 + 10 ELSE NULL END node FROM p0), m AS (SELECT node, avg(x) mx, avg(y) my, avg(z) mz FROM p WHERE node IS NOT NULL GROUP BY node) SELECT g, seq, round(coalesce(mx, x), 6) + 0.0 AS x, round(coalesce(my, y), 6) + 0.0 AS y, round(coalesce(mz, z), 6) + 0.0 AS z FROM p LEFT JOIN m USING (node)"


def _pdb_lines(spark, d):
    """Embeddings written as the fixed-width records of a structure: alpha carbons between other atoms. Residues are
    numbered up to 9,999 and then once more under the next insertion code."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = lambda k: F.round(F.col("embedding")[k].cast("double") * 10, 3)
    line = lambda atom, n: F.format_string("%-6s%5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f", F.lit("ATOM"), n % 100000, F.lit(atom), F.lit("GLY"), F.when(F.col("label") % 2 == 0, "A").otherwise("B"), F.col("vec_id") % 10000, F.when(F.col("vec_id") < 10000, " ").otherwise(F.char(64 + F.floor(F.col("vec_id") / 10000))), v(0), v(1), v(2))
    both = F.array(F.struct((3 * F.col("vec_id")).alias("n"), line(" N", 3 * F.col("vec_id")).alias("value")), F.struct((3 * F.col("vec_id") + 1).alias("n"), line(" CA", 3 * F.col("vec_id") + 1).alias("value")), F.struct((3 * F.col("vec_id") + 2).alias("n"), F.concat(F.lit("HETATM"), F.substring(line(" CA", 3 * F.col("vec_id") + 2), 7, 80)).alias("value")))
    return e.select(F.explode(both).alias("r")).select("r.*")


PDB = "ca AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, CAST(vec_id % 10000 AS INTEGER) AS res_seq, round(CAST(embedding[1] AS DOUBLE) * 10, 3) x, round(CAST(embedding[2] AS DOUBLE) * 10, 3) y, round(CAST(embedding[3] AS DOUBLE) * 10, 3) z FROM embeddings WHERE label % 2 = 0)"
ARCS = [(0, 0, 10, 20), (0, 1, 40, 35), (1, 0, 10, 2), (2, 0, 5, 30), (2, 1, 50, 52)]


def _codes(spark, d):
    c = spark.createDataFrame([("5osqA",), ("1aoc",), ("1aocBB",), ("ab",)], "code string")
    a, b = pdb.split_code(F.col("code"))
    return c.select("code", F.coalesce(a, F.lit("-")).alias("structure"), F.coalesce(b, F.lit("-")).alias("chain"))


FOURIER = [(0, 0, 0, 0, 0, -1.0, 0.0), (0, 0, 1, 0, 0, 0.5, 0.0), (0, 0, -1, 0, 0, 0.5, 0.0), (0, 0, 0, 1, 0, 0.5, 0.1), (1, 1, 0, 0, 0, 1.0, 0.0), (1, 1, 0, 0, 1, 0.25, 0.0), (1, 1, 1, 0, 0, -0.5, 0.0), (1, 1, -1, 0, 0, -0.5, 0.0), (0, 1, 1, 0, 0, 0.0, -0.5), (0, 1, -1, 1, 0, 0.0, 0.5), (1, 0, 1, 0, 1, 0.0, -0.5), (1, 0, -1, 0, 0, 0.0, 0.5)]
KIND = "i int, j int, n1 int, n2 int, n3 int, re double, im double"
FSQL = "fo AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in FOURIER) + ") t(i, j, n1, n2, n3, re, im)), me AS (SELECT a.i * 0.5::DOUBLE k2, b.i * 0.5::DOUBLE k3 FROM range(-3, 4) a(i), range(-3, 4) b(i))"
HOPS = f"WITH {FSQL}, ph AS (SELECT *, n2 * k2 + n3 * k3 t FROM fo, me), ho AS (SELECT k2, k3, n1 AS shift, i, j, sum(re * cos(t) - im * sin(t)) re, sum(re * sin(t) + im * cos(t)) im FROM ph GROUP BY ALL)"


def mesh(spark):
    r = spark.range(-3, 4)
    return r.select((F.col("id") * 0.5).alias("k2")).crossJoin(r.select((F.col("id") * 0.5).alias("k3")))


def hops(spark):
    return slab.hoppings(spark.createDataFrame(FOURIER, KIND), mesh(spark), "x")


def _matrix(periodic):
    def run(spark, d):
        return slab.matrices(hops(spark), 4, 2, periodic).select("k2", "k3", "row", "col", r6(F.col("re"), "re"), r6(F.col("im"), "im"))

    to = "((n + shift) % 4 + 4) % 4" if periodic else "n + shift"
    return run, HOPS + f", nn AS (SELECT *, unnest(range(4)) n FROM ho), mm AS (SELECT *, {to} m FROM nn) SELECT k2, k3, n * 2 + i AS row, m * 2 + j AS col, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM mm WHERE m >= 0 AND m < 4 GROUP BY 1, 2, 3, 4"


def _eig(spark, d):
    got = slab.eigenvalues(slab.matrices(hops(spark), 4, 2, False), 8)
    return got.select("k2", "k3", "band", r6(F.col("re"), "re"), r6(F.col("im"), "im"))


def _eig_moments(spark, d):
    """Sums of the eigenvalues of the open slab and of their squares, which are traces."""
    e = slab.eigenvalues(slab.matrices(hops(spark), 4, 2, False), 8)
    square = (F.col("re") ** 2 - F.col("im") ** 2, 2 * F.col("re") * F.col("im"))
    r = lambda c, n: (F.round(F.sum(c), 5) + 0.0).alias(n)
    return e.groupBy("k2", "k3").agg(r(F.col("re"), "s1_re"), r(F.col("im"), "s1_im"), r(square[0], "s2_re"), r(square[1], "s2_im"))


EIG_MOMENTS = HOPS + """, nn AS (SELECT *, unnest(range(4)) n FROM ho), mm AS (SELECT k2, k3, n * 2 + i r, (n + shift) * 2 + j c, sum(re) re, sum(im) im FROM nn WHERE n + shift BETWEEN 0 AND 3 GROUP BY 1, 2, 3, 4),
t1 AS (SELECT k2, k3, sum(re) re, sum(im) im FROM mm WHERE r = c GROUP BY 1, 2), t2 AS (SELECT a.k2, a.k3, sum(a.re * b.re - a.im * b.im) re, sum(a.re * b.im + a.im * b.re) im FROM mm a JOIN mm b ON a.k2 = b.k2 AND a.k3 = b.k3 AND a.c = b.r AND a.r = b.c GROUP BY 1, 2)
SELECT t1.k2, t1.k3, round(t1.re, 5) + 0.0 AS s1_re, round(t1.im, 5) + 0.0 AS s1_im, round(t2.re, 5) + 0.0 AS s2_re, round(t2.im, 5) + 0.0 AS s2_im FROM t1 JOIN t2 ON t1.k2 = t2.k2 AND t1.k3 = t2.k3"""


def _modes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = e.select((F.col("vec_id") % 7).cast("double").alias("k2"), (F.col("label") * 1.0).alias("k3"), F.col("embedding")[0].cast("double").alias("re"), F.col("embedding")[1].cast("double").alias("im"))
    return slab.surface_modes(v, 0.4)


def _kron(spark, d):
    a = slab.shift_matrix(spark, 4, 1, True)
    b = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") % 5).cast("bigint").alias("row"), F.floor(F.col("n_nationkey") / 5).alias("col"), F.col("n_regionkey").cast("double").alias("value"))
    return slab.kron(a, b, 5, 5)


def _hermite(spark, d):
    """Blends from every point of a curve to the next."""
    w = Window.partitionBy("g").orderBy("seq")
    p = curves(spark, d).select("g", "seq", F.col("x").alias("p0"), F.lead("x").over(w).alias("p1"), F.col("y").alias("m0"), F.lead("y").over(w).alias("m1")).where("p1 IS NOT NULL")
    rows = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return rows.select("g", "seq", F.col("k").cast("bigint").alias("k"), r6(cv.hermite(F.col("p0"), F.col("p1"), F.col("m0"), F.col("m1"), F.col("k") / 4), "x"))


def uneven(spark, d):
    """Curves of one, two and four points that take up all vectors."""
    p = groups(spark, d, 7)
    part = F.when(F.col("seq") < 1, 0).when(F.col("seq") < 3, 1).otherwise(2)
    return p.select((F.col("g") * 3 + part).alias("g"), (F.col("seq") - F.when(F.col("seq") < 1, 0).when(F.col("seq") < 3, 1).otherwise(3)).alias("seq"), "x", "y", "z")


UNEVEN = f"{groups_sql(7).replace('p AS', 'p0 AS')}, p1 AS (SELECT g * 3 + CASE WHEN seq < 1 THEN 0 WHEN seq < 3 THEN 1 ELSE 2 END AS g, seq - CASE WHEN seq < 1 THEN 0 WHEN seq < 3 THEN 1 ELSE 3 END AS seq, x, y, z FROM p0), p AS (SELECT *, count(*) OVER (PARTITION BY g) n FROM p1)"


def _replace(spark, d):
    """The end of each curve that is closer to its middle point is moved to its mean."""
    p = curves(spark, d)
    n = F.count("*").over(Window.partitionBy("g"))
    mid = p.withColumn("n", n).where("seq = floor(n / 2)").select("g", *[F.col(a).alias(f"o{a}") for a in "xyz"])
    mean = p.groupBy("g").agg(*[F.avg(a).alias(f"n{a}") for a in "xyz"])
    return xyz(cv.replace_endpoint(p, mid.join(mean, "g")), "g", "seq")


_FAR = "(x - ox) ** 2 + (y - oy) ** 2 + (z - oz) ** 2"
REPLACE = f"WITH {PTS}, n AS (SELECT g, count(*) n, avg(x) nx, avg(y) ny, avg(z) nz FROM pts GROUP BY g), o AS (SELECT pts.g, x ox, y oy, z oz, n, nx, ny, nz FROM pts JOIN n ON n.g = pts.g AND seq = n // 2), e AS (SELECT pts.g, arg_min(seq, {_FAR}) goes FROM pts JOIN o ON o.g = pts.g WHERE seq IN (0, n - 1) GROUP BY pts.g) SELECT pts.g, seq, " + ", ".join(f"round(CASE WHEN seq = goes THEN n{a} ELSE {a} END, 6) + 0.0 AS {a}" for a in "xyz") + " FROM pts JOIN o ON o.g = pts.g JOIN e ON e.g = pts.g"
TUBE = f"""WITH {PTS}, d0 AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) ax, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) ay, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) az FROM pts WINDOW w AS (PARTITION BY g ORDER BY seq)),
d1 AS (SELECT g, seq, x, y, z, ax / n dx, ay / n dy, az / n dz FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) n FROM d0) WHERE n > 0), u0 AS (SELECT *, CASE WHEN abs(dz) < 0.9 THEN dy ELSE 0 END ax, CASE WHEN abs(dz) < 0.9 THEN -dx ELSE dz END ay, CASE WHEN abs(dz) < 0.9 THEN 0 ELSE -dy END az FROM d1),
u AS (SELECT *, ax / n ux, ay / n uy, az / n uz FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) n FROM u0)), v AS (SELECT *, dy * uz - dz * uy vx, dz * ux - dx * uz vy, dx * uy - dy * ux vz FROM u), s AS (SELECT *, unnest(range(6)) i FROM v)
SELECT g, seq, CAST(i AS INTEGER) AS side, """ + ", ".join(f"round({a} + 0.1::DOUBLE * (cos(i * 2 * pi() / 6) * u{a} + sin(i * 2 * pi() / 6) * v{a}), 5) + 0.0 AS {a}" for a in "xyz") + " FROM s"


def _tubes(spark, d):
    return cv.tubes(curves(spark, d), 0.1, 6).select("g", "seq", "side", *[(F.round(a, 5) + 0.0).alias(a) for a in "xyz"])


def _triangles(spark, d):
    got = cv.tube_triangles(curves(spark, d), 6)
    return got.groupBy("g").agg(F.count("*").alias("triangles"), F.countDistinct("a").alias("corners"), F.max(F.greatest("a", "b", "c")).cast("bigint").alias("last"))


def _directions(spark, d):
    """Slab matrices along each of the three axes, open and periodic, by their sums."""
    out = None
    for axis in "xyz":
        for closed in (False, True):
            m = slab.matrices(slab.hoppings(spark.createDataFrame(FOURIER, KIND), mesh(spark), axis), 4, 2, closed)
            m = m.groupBy("k2", "k3").agg(F.count("*").alias("entries"), r6(F.sum("re"), "re"), r6(F.sum("im"), "im")).select(F.lit(axis).alias("axis"), F.lit(closed).alias("closed"), "k2", "k3", "entries", "re", "im")
            out = m if out is None else out.unionByName(m)
    return out


def _directions_sql():
    parts = []
    for axis, (a, b, c) in {"x": (1, 2, 3), "y": (2, 3, 1), "z": (3, 1, 2)}.items():
        for closed in (False, True):
            to, where = ("((n + shift) % 4 + 4) % 4", "true") if closed else ("n + shift", "n + shift BETWEEN 0 AND 3")
            parts.append(f"SELECT '{axis}' AS axis, {str(closed).lower()} AS closed, k2, k3, count(*) AS entries, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM (SELECT k2, k3, n, i, j, {to} m, sum(re) re, sum(im) im FROM (SELECT k2, k3, n{a} shift, i, j, unnest(range(4)) n, re * cos(n{b} * k2 + n{c} * k3) - im * sin(n{b} * k2 + n{c} * k3) re, re * sin(n{b} * k2 + n{c} * k3) + im * cos(n{b} * k2 + n{c} * k3) im FROM fo, me) WHERE {where} GROUP BY ALL) GROUP BY k2, k3")
    return f"WITH {FSQL} " + " UNION ALL ".join(parts)


def _cross(spark, d):
    """Whether the pieces of a curve cross each other, apart from neighbours."""
    from ..operators import geometry as geo

    segs = geo.segments(curves(spark, d))
    n = geo.crossings(segs).groupBy("g").agg(F.count("*").alias("n"))
    return segs.select("g").distinct().join(n, "g", "left").select("g", F.col("n").isNotNull().alias("crosses"))


def plans():
    total = "SELECT g, total, n FROM tl"
    return {
        "resample": (lambda s, d: xyz(cv.resample(curves(s, d), 0.5), "g", "k"), asof(f"SELECT g, k, total * k / m s FROM (SELECT g, total, m, unnest(range(m + 1)) k FROM (SELECT g, total, greatest(2, CAST(round(total / 0.5) AS BIGINT)) m FROM ({total})))")),
        "resample_asof": (lambda s, d: xyz(cv.at_lengths(curves(s, d), curves(s, d).select("g", F.col("seq").alias("k"), (F.col("seq") * 0.37).alias("s"))), "g", "k"), asof("SELECT g, seq AS k, seq * 0.37::DOUBLE s FROM pts")),
        "densify": (lambda s, d: xyz(cv.densify(uneven(s, d)), "g", "seq"), f"WITH {UNEVEN} SELECT g, seq * 2 AS seq, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM p UNION ALL SELECT g, 1, round(avg(x), 6) + 0.0, round(avg(y), 6) + 0.0, round(avg(z), 6) + 0.0 FROM p WHERE n = 2 GROUP BY g"),
        "replace_endpoint": (_replace, REPLACE),
        "tube_points": (_tubes, TUBE),
        "tube_triangles": (_triangles, f"WITH {PTS}, n AS (SELECT g, count(*) n FROM pts GROUP BY g) SELECT g, (n - 1) * 12 AS triangles, (n - 1) * 6 AS corners, n * 6 - 1 AS \"last\" FROM n"),
        "slab_directions": (_directions, _directions_sql()),
        "control_points": (lambda s, d: xyz(cv.control_points(curves(s, d), 4), "g", "k"), asof("SELECT g, k, total * k / 5 s FROM (SELECT g, total, unnest(range(1, 5)) k FROM tl)")),
        "rest_lengths": (lambda s, d: cv.rest_lengths(curves(s, d)).select("g", r6(F.col("rest"), "rest"), r6(F.col("median"), "median")), f"WITH {P3} SELECT g, round(total / n, 6) + 0.0 AS rest, round((SELECT median(total) FROM tl), 6) + 0.0 AS median FROM tl"),
        "relax_step": (_relax, RELAX),
        "tangent_repulsion": (_tangent, TANGENT),
        "bezier": (_bezier, BEZIER),
        "length_energy": (lambda s, d: cv.length_energy(curves(s, d), F.lit(10.0)).select("g", r6(F.col("energy"), "energy")), f"WITH {P3} SELECT g, round((total - 10.0) ** 2, 6) + 0.0 AS energy FROM tl"),
        "bending_energy": (lambda s, d: cv.bending_energy(curves(s, d)).select("g", r6(F.col("energy"), "energy")), f"WITH {PTS}, b AS (SELECT g, (lead(x) OVER w - 2 * x + lag(x) OVER w) ** 2 + (lead(y) OVER w - 2 * y + lag(y) OVER w) ** 2 + (lead(z) OVER w - 2 * z + lag(z) OVER w) ** 2 b FROM pts WINDOW w AS (PARTITION BY g ORDER BY seq)) SELECT g, round(sum(b), 6) + 0.0 AS energy FROM b GROUP BY g"),
        "tpe_energy": (lambda s, d: cv.tangent_point_energy(curves(s, d)).select("g", (F.round("energy", 4) + 0.0).alias("energy")), f"WITH {P3}, m AS (SELECT g, seg, len, (x1 + x2) / 2 mx, (y1 + y2) / 2 my, (z1 + z2) / 2 mz, (x2 - x1) / len tx, (y2 - y1) / len ty, (z2 - z1) / len tz FROM pc WHERE len > 0), q AS (SELECT a.g, a.len * b.len ll, (b.mx - a.mx) ** 2 + (b.my - a.my) ** 2 + (b.mz - a.mz) ** 2 + 1e-9 d2, (b.mx - a.mx) * a.tx + (b.my - a.my) * a.ty + (b.mz - a.mz) * a.tz al FROM m a JOIN m b ON a.g = b.g AND abs(a.seg - b.seg) > 1) SELECT g, round(sum(greatest(0.0, d2 - al * al) / (d2 * d2) * ll), 4) + 0.0 AS energy FROM q GROUP BY g"),
        "glue_endpoints": (_glue, GLUE),
        "recenter": (lambda s, d: xyz(cv.recenter(curves(s, d)), "g", "seq"), f"WITH {PTS} SELECT g, seq, round(x - avg(x) OVER w, 6) + 0.0 AS x, round(y - avg(y) OVER w, 6) + 0.0 AS y, round(z - avg(z) OVER w, 6) + 0.0 AS z FROM pts WINDOW w AS (PARTITION BY g)"),
        "closure_point": (lambda s, d: xyz(cv.closure_point(curves(s, d), (1.0, 2.0, 2.0)), "g"), f"WITH {PTS}, m AS (SELECT g, avg(x) mx, avg(y) my, avg(z) mz FROM pts GROUP BY g), r AS (SELECT g, mx, my, mz, max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) r FROM pts JOIN m USING (g) GROUP BY ALL) SELECT g, round(mx + r * 2 / 3, 6) + 0.0 AS x, round(my + r * 4 / 3, 6) + 0.0 AS y, round(mz + r * 4 / 3, 6) + 0.0 AS z FROM r"),
        "hermite_blend": (_hermite, f"WITH {PTS}, p AS (SELECT g, seq, x p0, lead(x) OVER w p1, y m0, lead(y) OVER w m1 FROM pts WINDOW w AS (PARTITION BY g ORDER BY seq)), k AS (SELECT *, unnest(range(5)) k FROM p WHERE p1 IS NOT NULL), t AS (SELECT *, k / 4.0::DOUBLE t FROM k) SELECT g, seq, k, round((2 * t ** 3 - 3 * t ** 2 + 1) * p0 + (t ** 3 - 2 * t ** 2 + t) * m0 + (3 * t ** 2 - 2 * t ** 3) * p1 + (t ** 3 - t ** 2) * m1, 6) + 0.0 AS x FROM t"),
        "edges_cross": (_cross, "WITH " + PTS + ", " + chain() + " SELECT g, g IN (SELECT g FROM cr) AS crosses FROM tl"),
        "pdb_code": (_codes, "SELECT * FROM (VALUES ('5osqA', '5OSQ', 'A'), ('1aoc', '1AOC', '-'), ('1aocBB', '1AOC', 'BB'), ('ab', '-', '-')) t(code, structure, chain)"),
        "pdb_ca": (lambda s, d: xyz(pdb.alpha_carbons(_pdb_lines(s, d), "A"), "i", "res_seq"), f"WITH {PDB} SELECT i, res_seq, x, y, z FROM ca"),
        "theta_from_pdb": (lambda s, d: xyz(pdb.theta_arcs(pdb.alpha_carbons(_pdb_lines(s, d), "A"), ARCS), "g", "seq"), f"WITH {PDB}, ps AS (SELECT * FROM (VALUES " + ", ".join(f"({g}, {o}, {a}, {b})" for g, o, a, b in ARCS) + ") t(g, o, a, b)), rn AS (SELECT g, o, k, CASE WHEN b >= a THEN a + k ELSE a - k END i FROM (SELECT *, unnest(range(abs(b - a) + 1)) k FROM ps)) SELECT CAST(g AS BIGINT) AS g, row_number() OVER (PARTITION BY g ORDER BY o, k) - 1 AS seq, x, y, z FROM rn JOIN ca USING (i)"),
        "hoppings": (lambda s, d: hops(s).select("k2", "k3", "shift", "i", "j", r6(F.col("re"), "re"), r6(F.col("im"), "im")), HOPS + " SELECT k2, k3, shift, i, j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM ho"),
        "slab_matrix": _matrix(False),
        "slab_matrix_periodic": _matrix(True),
        "slab_eig": (_eig, None),
        "slab_eig_moments": (_eig_moments, EIG_MOMENTS),
        "surface_mode_count": (_modes, "SELECT CAST(vec_id % 7 AS DOUBLE) AS k2, CAST(label AS DOUBLE) AS k3, count(*) AS modes FROM embeddings WHERE sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2) < 0.4 GROUP BY 1, 2"),
        "shift_matrix": (lambda s, d: slab.shift_matrix(s, 6, 2, True), "SELECT i AS row, (i + 2) % 6 AS col, 1.0::DOUBLE AS value FROM range(6) t(i)"),
        "kron": (_kron, "SELECT a.i * 5 + n_nationkey % 5 AS row, ((a.i + 1) % 4) * 5 + n_nationkey // 5 AS col, CAST(n_regionkey AS DOUBLE) AS value FROM range(4) a(i), nation"),
    }
