"""Queries of the grid and field operators, with their DuckDB twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.cplx import Z
from ..operators import fields, models
from ..operators.connected import components
from ..sources.grids import TAU_SPAN, kgrid

N, GAMMA = 16, 0.4
HALF = (TAU_SPAN[0], TAU_SPAN[1], (0.0, math.pi))


def r6(c, name):
    return (F.round(c, 6) + 0.0).alias(name)


def steps(n, span):
    return tuple((hi - lo) / (n - 1) for lo, hi in span)


def num(x):
    """A DOUBLE in DuckDB, where plain decimals are exact."""
    return f"CAST({x!r} AS DOUBLE)"


def grid_sql(n, span=TAU_SPAN):
    ks = ", ".join(f"{num(lo)} + i{a} * {num((hi - lo) / (n - 1))} AS k{a}" for a, (lo, hi) in zip("xyz", span))
    return f"g0 AS (SELECT CAST(i // {n * n} AS BIGINT) ix, CAST((i // {n}) % {n} AS BIGINT) iy, CAST(i % {n} AS BIGINT) iz FROM range({n**3}) t(i)), k AS (SELECT *, {ks} FROM g0)"


def model_sql(name, mirror=False, n=N, span=TAU_SPAN):
    """CTEs ending in d(ix, iy, iz, kx, ky, kz, fr, fi)."""
    c = models.MIRROR_C.get(name, 0.5) if mirror else 0.0
    third = f"{'cos(2 * kz)' if mirror else 'sin(kz)'} + {c!r}"
    sql = f"WITH {grid_sql(n, span)}, p1 AS (SELECT *, {third} z1r, cos(kx) + cos(ky) + cos(kz) - 2.0 z1i, sin(kx) w1r, sin(ky) w1i FROM k)"
    for i in range(2, 6):
        sql += f", p{i} AS (SELECT *, " + ", ".join(f"{v}{i - 1}r * {v}1r - {v}{i - 1}i * {v}1i {v}{i}r, {v}{i - 1}r * {v}1i + {v}{i - 1}i * {v}1r {v}{i}i" for v in "zw") + f" FROM p{i - 1})"
    sign = "-" if mirror else "+"
    if name in models.TORUS:
        p, q = models.TORUS[name]
        f = f"z{p}r {sign} w{q}r fr, z{p}i {sign} w{q}i fi"
    elif name == "threelink":
        f = "(z2r - w2r) * z1r - (z2i - w2i) * z1i fr, (z2r - w2r) * z1i + (z2i - w2i) * z1r fi"
    else:
        f = "z1r * (z2r - w4r + w1r) - z1i * (z2i - w4i + w1i) fr, z1r * (z2i - w4i + w1i) + z1i * (z2r - w4r + w1r) fi"
    return sql + f", d AS (SELECT *, {f} FROM p5)"


def _model(name, mirror=False):
    def run(spark, sf_dir):
        d = models.named(name, GAMMA, mirror)
        rows = models.on_grid(kgrid(spark, N), d)
        # four digits: offsets of three decimals put products on rounding ties at six
        return rows.select("ix", "iy", "iz", (F.round("dx_re", 4) + 0.0).alias("dx"), r6(F.col("dy_im"), "dy_im"), (F.round("dz_re", 4) + 0.0).alias("dz"))

    return run, model_sql(name, mirror) + f" SELECT ix, iy, iz, round(fr, 4) + 0.0 AS dx, CAST({GAMMA} AS DOUBLE) AS dy_im, round(fi, 4) + 0.0 AS dz FROM d"


def _zw(spark, sf_dir):
    z, w = models.lift()
    return kgrid(spark, N).select("ix", "iy", "iz", r6(z.re, "z_re"), r6(z.im, "z_im"), r6(w.re, "w_re"), r6(w.im, "w_im"))


def _grid(spark, sf_dir):
    return kgrid(spark, N, HALF).select("ix", "iy", "iz", r6(F.col("kx"), "kx"), r6(F.col("ky"), "ky"), r6(F.col("kz"), "kz"))


def _bloch(spark, sf_dir):
    """A matrix given by entries, projected on the Pauli matrices."""
    x, y, z = F.col("kx"), F.col("ky"), F.col("kz")
    zero = F.lit(0.0)
    d = models.from_matrix(Z(F.cos(x), F.sin(y)), Z(F.sin(z), F.cos(y)), Z(F.cos(z), F.sin(x)), Z(F.sin(x), zero))
    rows = models.on_grid(kgrid(spark, N), d)
    return rows.select("ix", "iy", "iz", *[r6(F.col(f"d{a}_{p}"), f"d{a}_{p}") for a in "xyz" for p in ("re", "im")])


BLOCH_SQL = f"""WITH {grid_sql(N)} SELECT ix, iy, iz,
round((sin(kz) + cos(kz)) / 2, 6) + 0.0 AS dx_re, round((cos(ky) + sin(kx)) / 2, 6) + 0.0 AS dx_im,
round(-(cos(ky) - sin(kx)) / 2, 6) + 0.0 AS dy_re, round((sin(kz) - cos(kz)) / 2, 6) + 0.0 AS dy_im,
round((cos(kx) - sin(kx)) / 2, 6) + 0.0 AS dz_re, round(sin(ky) / 2, 6) + 0.0 AS dz_im FROM k"""

HOPF = model_sql("hopf", True, N, HALF)
S = f"fr * fr - {GAMMA * GAMMA!r} + fi * fi"


def hopf(spark, n=N):
    return kgrid(spark, n, HALF), models.named("hopf", GAMMA, True)


def _spectrum(spark, sf_dir):
    return fields.spectrum(*hopf(spark)).select("ix", "iy", "iz", r6(F.col("e_re"), "e_re"), r6(F.col("e_im"), "e_im"))


def _gap(spark, sf_dir):
    return fields.spectrum(*hopf(spark)).select("ix", "iy", "iz", r6(F.col("gap"), "gap"))


def _interior(spark, sf_dir):
    return fields.interior(*hopf(spark, 32)).groupBy("iz").agg(F.count("*").alias("points"), F.sum("ix").alias("sx"), F.sum("iy").alias("sy"))


def interior_sql(n):
    return model_sql("hopf", True, n, HALF) + f", m AS (SELECT ix, iy, iz FROM d WHERE {S} <= 0)"


def _gradient(value, order):
    def run(spark, sf_dir):
        rows = fields.gradient(fields.spectrum(*hopf(spark)), value, steps(N, HALF), order)
        return rows.select("ix", "iy", "iz", r6(F.col("gx"), "gx"), r6(F.col("gy"), "gy"), r6(F.col("gz"), "gz"))

    return run


ENERGY = HOPF + f", e AS (SELECT *, CASE WHEN {S} >= 0 THEN sqrt({S}) ELSE 0.0 END e_re, CASE WHEN {S} < 0 THEN sqrt(-({S})) ELSE 0.0 END e_im FROM d)"


def gradient_sql(v, order, source="e", names=("gx", "gy", "gz")):
    out = []
    for a, h, name in zip("xyz", steps(N, HALF), names):
        w = f"(PARTITION BY {', '.join(i for i in ('ix', 'iy', 'iz') if i != 'i' + a)} ORDER BY i{a})"
        f1, b1, f2, b2 = f"lead({v}) OVER {w}", f"lag({v}) OVER {w}", f"lead({v}, 2) OVER {w}", f"lag({v}, 2) OVER {w}"
        first, last = (f"({f1} - {v}) / {h!r}", f"({v} - {b1}) / {h!r}") if order == 1 else (f"(-3 * {v} + 4 * {f1} - {f2}) / {2 * h!r}", f"(3 * {v} - 4 * {b1} + {b2}) / {2 * h!r}")
        out.append(f"CASE WHEN {b1} IS NULL THEN {first} WHEN {f1} IS NULL THEN {last} ELSE ({f1} - {b1}) / {2 * h!r} END AS {name}")
    return ", ".join(out)


def _berry(spark, sf_dir):
    grid, d = hopf(spark)
    rows = fields.berry_curvature(models.on_grid(grid, d), GAMMA, steps(N, HALF), sign=-1)
    return rows.select("ix", "iy", "iz", r6(F.col("bx"), "bx"), r6(F.col("by"), "by"), r6(F.col("bz"), "bz"))


def berry_sql():
    eps = f"({GAMMA * GAMMA!r} - fr * fr - fi * fi)"
    p, q = gradient_sql("fr", 1, names=("px", "py", "pz")), gradient_sql("fi", 1, names=("qx", "qy", "qz"))
    c = {"x": "yz", "y": "zx", "z": "xy"}
    return HOPF + f", t AS (SELECT *, {p}, {q} FROM d) SELECT ix, iy, iz, " + ", ".join(f"round(CASE WHEN {eps} > 0 THEN {-GAMMA!r} / (2 * {eps} * sqrt(greatest({eps}, 1e-300))) * (q{u} * p{v} - q{v} * p{u}) ELSE 0.0 END, 6) + 0.0 AS b{a}" for a, (u, v) in c.items()) + " FROM t"


def _volume(spark, sf_dir):
    rows = fields.volume(*hopf(spark), steps(N, HALF))
    return rows.select("ix", "iy", "iz", *[r6(F.col(c), c) for c in ("e_re", "e_im", "gap", "es_helper", "im_norm", "im_log")], "interior")


def volume_sql():
    g = gradient_sql("e_im", 2, names=("vx", "vy", "vz"))
    return ENERGY + f", t AS (SELECT *, {g} FROM e), u AS (SELECT *, CASE WHEN e_re = 0 THEN sqrt(vx * vx + vy * vy + vz * vz) ELSE 0.0 END im_norm FROM t) SELECT ix, iy, iz, round(e_re, 6) + 0.0 AS e_re, round(e_im, 6) + 0.0 AS e_im, round(2 * sqrt(e_re * e_re + e_im * e_im), 6) + 0.0 AS gap, round(abs(e_re) - abs(e_im), 6) + 0.0 AS es_helper, round(im_norm, 6) + 0.0 AS im_norm, round(log10(im_norm + 1), 6) + 0.0 AS im_log, e_re = 0 AS interior FROM u"


def _derivative(spark, sf_dir):
    """A derived field: the gradient of the gap's logarithm, nulled outside the interior."""
    rows = fields.spectrum(*hopf(spark)).withColumn("v", F.log(F.col("gap") + 1))
    rows = fields.gradient(rows, "v", steps(N, HALF))
    return rows.where("e_re = 0").select("ix", "iy", "iz", r6(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2), "norm"))


def derivative_sql():
    g = gradient_sql("v", 1)
    return ENERGY + f", f AS (SELECT *, ln(2 * sqrt(e_re * e_re + e_im * e_im) + 1) v FROM e), t AS (SELECT *, {g} FROM f) SELECT ix, iy, iz, round(sqrt(gx * gx + gy * gy + gz * gz), 6) + 0.0 AS norm FROM t WHERE e_re = 0"


def _surface(spark, sf_dir):
    rows = fields.spectrum(*hopf(spark)).withColumn("v", F.round(F.abs("e_re") - F.abs("e_im"), 9))
    return fields.surface_points(rows, "v").select(F.col("axis").cast("bigint").alias("axis"), "ix", "iy", "iz", r6(F.col("t"), "t"))


def surface_sql():
    parts = []
    for k, a in enumerate("xyz"):
        w = f"(PARTITION BY {', '.join(i for i in ('ix', 'iy', 'iz') if i != 'i' + a)} ORDER BY i{a})"
        parts.append(f"SELECT CAST({k} AS BIGINT) AS axis, ix, iy, iz, v, lead(v) OVER {w} n FROM f")
    return ENERGY + f", f AS (SELECT ix, iy, iz, round(abs(e_re) - abs(e_im), 9) v FROM e), s AS ({' UNION ALL '.join(parts)}) SELECT axis, ix, iy, iz, round(v / (v - n), 6) + 0.0 AS t FROM s WHERE (v < 0) <> (n < 0)"


def _coordinates(spark, sf_dir):
    rows = fields.to_coordinates(fields.interior(*hopf(spark)), steps(N, HALF), tuple(lo for lo, _ in HALF))
    return rows.select("ix", "iy", "iz", *[r6(F.col(a), a) for a in "xyz"])


def _silhouette(spark, sf_dir):
    return fields.silhouettes(fields.interior(*hopf(spark, 32)))


def _euler(spark, sf_dir):
    return fields.euler(fields.interior(*hopf(spark, 32)))


def euler_sql():
    return interior_sql(32) + ", o AS (SELECT unnest(range(3)) v), c AS (SELECT DISTINCT 2 * ix + a.v x, 2 * iy + b.v y, 2 * iz + c.v z FROM m, o a, o b, o c) SELECT count(*) AS cells, CAST(sum(CASE WHEN (x % 2 + y % 2 + z % 2) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS euler FROM c"


def _components(spark, sf_dir):
    """Components of the mask by shared corners: their least voxel and size."""
    n = N
    code = lambda p: (F.col(f"{p}x") * n + F.col(f"{p}y")) * n + F.col(f"{p}z")
    voxels = fields.interior(*hopf(spark)).select("ix", "iy", "iz")
    near = fields.neighbours(voxels).select(code("i").alias("u"), code("j").alias("v"))
    found = components(near, _cut)
    rows = voxels.select(code("i").alias("v")).join(found, "v", "left").select(F.coalesce("component", "v").alias("component"))
    return rows.groupBy("component").agg(F.count("*").alias("voxels"))


def _cut(df):
    from .common import cut

    return cut(df)


def components_sql():
    return interior_sql(N).replace("WITH ", "WITH RECURSIVE ", 1) + f", v AS (SELECT (ix * {N} + iy) * {N} + iz id, ix, iy, iz FROM m), e AS (SELECT a.id u, b.id v FROM v a, v b WHERE abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1), r AS (SELECT id, id AS root FROM v UNION SELECT e.v, r.root FROM r, e WHERE e.u = r.id AND e.v > r.root), c AS (SELECT id, min(root) component FROM r GROUP BY id) SELECT component, count(*) AS voxels FROM c GROUP BY component"


def _eigen(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = lambda i: F.col("embedding")[i].cast("double")
    lo, hi = fields.eigenvalues_2x2(e(0), e(1), e(2), e(3))
    return rows.select("vec_id", r6(lo, "low"), r6(hi, "high"), r6((hi - lo) / 2, "pair"))


EIGEN_SQL = """WITH h AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) c, CAST(embedding[3] AS DOUBLE) br, CAST(embedding[4] AS DOUBLE) bi FROM embeddings),
r AS (SELECT *, sqrt((a - c) * (a - c) / 4 + br * br + bi * bi) s FROM h) SELECT vec_id, round((a + c) / 2 - s, 6) + 0.0 AS low, round((a + c) / 2 + s, 6) + 0.0 AS high, round(s, 6) + 0.0 AS pair FROM r"""


def _eigen_n(spark, sf_dir, digits=6):
    """Eigenvalues of a Hermitian 4x4 matrix per embedding, ascending, by batches."""
    from ..operators.kernels import eigvalsh

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return eigvalsh(rows, "vec_id", "e", 4, digits)


def _eigen_3(spark, sf_dir):
    """Eigenvalues of a Hermitian 3x3 matrix per embedding, ascending, in one row."""
    from ..operators.kernels import eigvalsh

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    got = eigvalsh(rows, "vec_id", "e", 3, None).groupBy("vec_id")
    return got.agg(*[(F.round(F.max(F.when(F.col("band") == k, F.col("value"))), 5) + 0.0).alias(n) for k, n in enumerate(("low", "mid", "high"))])


# the cubic's roots by angles: p is the spread of the matrix about its mean q, and r its determinant in these units
EIGEN_3 = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings), h AS (SELECT vec_id, e[1] a, e[2] b, e[3] c, e[4] ur, e[5] ui, e[6] vr, e[7] vi, e[8] wr, e[9] wi FROM e),
q AS (SELECT *, (a + b + c) / 3 q, ur * ur + ui * ui u2, vr * vr + vi * vi v2, wr * wr + wi * wi w2 FROM h), p AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (u2 + v2 + w2)) / 6) p FROM q),
r AS (SELECT *, ((a - q) * (b - q) * (c - q) + 2 * ((ur * wr - ui * wi) * vr + (ur * wi + ui * wr) * vi) - (a - q) * w2 - (b - q) * v2 - (c - q) * u2) / (2 * p ** 3) r FROM p),
t AS (SELECT *, acos(greatest(-1.0, least(1.0, r))) / 3 t FROM r), l AS (SELECT vec_id, q, q + 2 * p * cos(t) high, q + 2 * p * cos(t + 2 * pi() / 3) low FROM t)
SELECT vec_id, round(low, 5) + 0.0 AS low, round(3 * q - low - high, 5) + 0.0 AS mid, round(high, 5) + 0.0 AS high FROM l"""


def _moments(spark, sf_dir):
    """Power sums of the eigenvalues of the 4x4 matrices, which are the traces of their powers."""
    e = _eigen_n(spark, sf_dir, None).groupBy("vec_id")
    return e.agg(*[(F.round(F.sum(F.pow("value", F.lit(k))), 3) + 0.0).alias(f"m{k}") for k in (1, 2, 3, 4)])


def moments_sql():
    upper, at = [(i, j) for i in range(4) for j in range(i + 1, 4)], {}
    for i in range(4):
        at[i, i] = (f"e[{i + 1}]", "0.0::DOUBLE")
    for k, (i, j) in enumerate(upper):
        at[i, j], at[j, i] = (f"e[{5 + 2 * k}]", f"e[{6 + 2 * k}]"), (f"e[{5 + 2 * k}]", f"-e[{6 + 2 * k}]")
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 're': {re}, 'im': {im}}}" for (i, j), (re, im) in at.items())
    return f"""WITH h AS (SELECT vec_id, unnest([{cells}], recursive := true) FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings)),
s AS (SELECT a.vec_id, a.i, b.j, sum(a.re * b.re - a.im * b.im) re, sum(a.re * b.im + a.im * b.re) im FROM h a JOIN h b ON a.vec_id = b.vec_id AND a.j = b.i GROUP BY ALL),
m1 AS (SELECT vec_id, sum(re) m FROM h WHERE i = j GROUP BY vec_id), m2 AS (SELECT vec_id, sum(re) m FROM s WHERE i = j GROUP BY vec_id),
m3 AS (SELECT s.vec_id, sum(s.re * h.re - s.im * h.im) m FROM s JOIN h ON h.vec_id = s.vec_id AND s.j = h.i AND s.i = h.j GROUP BY s.vec_id), m4 AS (SELECT vec_id, sum(re * re + im * im) m FROM s GROUP BY vec_id)
SELECT m1.vec_id, {', '.join(f'round(m{k}.m, 3) + 0.0 AS m{k}' for k in (1, 2, 3, 4))} FROM m1 JOIN m2 USING (vec_id) JOIN m3 USING (vec_id) JOIN m4 USING (vec_id)"""


def _prerequisites(spark, sf_dir):
    return models.berry_prerequisites(models.on_grid(*hopf(spark)))


def _hermitian(spark, sf_dir):
    grid, d = hopf(spark)
    return fields.is_hermitian(grid, models.to_matrix(d)).select("is_hermitian")


def _pt(spark, sf_dir):
    return fields.is_pt_symmetric(kgrid(spark, N), models.named("hopf", GAMMA), N)


PT_SQL = model_sql("hopf") + f", a AS (SELECT ix, iy, iz, fr, fi FROM d), j AS (SELECT greatest(abs(a.fr - b.fr), abs(a.fi + b.fi), abs({GAMMA} + {GAMMA})) o FROM a JOIN a b ON a.ix = {N - 1} - b.ix AND a.iy = {N - 1} - b.iy AND a.iz = {N - 1} - b.iz) SELECT max(o) <= 1e-9 AS is_pt_symmetric FROM j"


def _sample(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.lit(7.5) + 7 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("embedding")[i].cast("double")))
    points = emb.select(F.col("vec_id").alias("pid"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return fields.sample(points, fields.spectrum(*hopf(spark)), "gap").select("pid", r6(F.col("gap"), "gap"))


def sample_sql():
    at = lambda i: f"7.5 + 7 * greatest(-1.0, least(1.0, CAST(embedding[{i}] AS DOUBLE)))"
    return ENERGY + f", p AS (SELECT vec_id pid, {at(1)} x, {at(2)} y, {at(3)} z FROM embeddings), o AS (SELECT unnest(range(2)) v), c AS (SELECT pid, CAST(floor(x) AS BIGINT) + a.v ix, CAST(floor(y) AS BIGINT) + b.v iy, CAST(floor(z) AS BIGINT) + c.v iz, CASE a.v WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE b.v WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE c.v WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END w FROM p, o a, o b, o c) SELECT pid, round(sum(w * 2 * sqrt(e_re * e_re + e_im * e_im)), 6) + 0.0 AS gap FROM c JOIN e USING (ix, iy, iz) GROUP BY pid"


def _opaque(spark, sf_dir):
    import numpy as np

    rows = models.opaque(kgrid(spark, N), lambda x, y, z: (np.sin(x), np.cos(y), np.sin(z) * np.cos(x)))
    return rows.select("ix", "iy", "iz", r6(F.col("dx"), "dx"), r6(F.col("dy"), "dy"), r6(F.col("dz"), "dz"))


def _berry_analytic(spark, sf_dir):
    """Curvature by the chain rule on z and w instead of differences, for the mirrored Hopf model."""
    from ..functions.cplx import mul, real

    grid, d = hopf(spark)
    kx, ky, kz = F.col("kx"), F.col("ky"), F.col("kz")
    z, w = models.lift(0.5, 2.0, True)
    dz = {"x": Z(F.lit(0.0), -F.sin(kx)), "y": Z(F.lit(0.0), -F.sin(ky)), "z": Z(-2 * F.sin(2 * kz), -F.sin(kz))}
    dw = {"x": Z(F.cos(kx), F.lit(0.0)), "y": Z(F.lit(0.0), F.cos(ky)), "z": Z(F.lit(0.0), F.lit(0.0))}
    df = {a: mul(real(2.0), Z(mul(z, dz[a]).re - mul(w, dw[a]).re, mul(z, dz[a]).im - mul(w, dw[a]).im)) for a in "xyz"}
    rows = models.on_grid(grid, d)
    eps2 = F.lit(GAMMA * GAMMA) - F.col("dx_re") ** 2 - F.col("dz_re") ** 2
    scale = F.lit(-GAMMA) / (2 * eps2 * F.sqrt(F.greatest(eps2, F.lit(1e-300))))
    cross = {"x": "yz", "y": "zx", "z": "xy"}
    return rows.select("ix", "iy", "iz", *[r6(F.when(eps2 > 0, scale * (df[u].im * df[v].re - df[v].im * df[u].re)).otherwise(0.0), f"b{a}") for a, (u, v) in cross.items()])


BERRY_ANALYTIC = f"""WITH {grid_sql(N, HALF)}, v AS (SELECT ix, iy, iz, cos(2 * kz) + 0.5 zr, cos(kx) + cos(ky) + cos(kz) - 2 zi, sin(kx) wr, sin(ky) wi, -sin(kx) zx, -sin(ky) zy, -2 * sin(2 * kz) zzr, -sin(kz) zzi, cos(kx) wx, cos(ky) wy FROM k),
f AS (SELECT *, zr * zr - zi * zi - wr * wr + wi * wi fr, 2 * (zr * zi - wr * wi) fi, 2 * (-zi * zx - wr * wx) xr, 2 * (zr * zx - wi * wx) xi, 2 * (-zi * zy + wi * wy) yr, 2 * (zr * zy - wr * wy) yi, 2 * (zr * zzr - zi * zzi) zr2, 2 * (zr * zzi + zi * zzr) zi2 FROM v),
e AS (SELECT *, {GAMMA * GAMMA!r} - fr * fr - fi * fi eps FROM f), s AS (SELECT *, CASE WHEN eps > 0 THEN -{num(GAMMA)} / (2 * eps * sqrt(eps)) ELSE 0 END s FROM e)
SELECT ix, iy, iz, round(s * (yi * zr2 - zi2 * yr), 6) + 0.0 AS bx, round(s * (zi2 * xr - xi * zr2), 6) + 0.0 AS by, round(s * (xi * yr - yi * xr), 6) + 0.0 AS bz FROM s"""


def plans():
    """name: (query, SQL or None)."""
    out = {f"model_{n}": _model(n) for n in ("hopf", "trefoil", "cinquefoil", "solomon", "unknot", "threelink", "awesome")}
    out |= {f"model_mirror_{n}": _model(n, True) for n in ("hopf", "trefoil", "cinquefoil", "solomon", "unknot", "threelink", "awesome")}
    coords = interior_sql(N) + " SELECT ix, iy, iz, " + ", ".join(f"round(i{a} * {num(h)} + {num(lo)}, 6) + 0.0 AS {a}" for a, h, (lo, _) in zip("xyz", steps(N, HALF), HALF)) + " FROM m"
    grad = lambda v, o: ENERGY + f", t AS (SELECT ix, iy, iz, {gradient_sql(v, o)} FROM e) SELECT ix, iy, iz, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(gz, 6) + 0.0 AS gz FROM t"
    return out | {
        "kgrid": (_grid, f"WITH {grid_sql(N, HALF)} SELECT ix, iy, iz, round(kx, 6) + 0.0 AS kx, round(ky, 6) + 0.0 AS ky, round(kz, 6) + 0.0 AS kz FROM k"),
        "model_zw": (_zw, model_sql("hopf") + " SELECT ix, iy, iz, round(z1r, 6) + 0.0 AS z_re, round(z1i, 6) + 0.0 AS z_im, round(w1r, 6) + 0.0 AS w_re, round(w1i, 6) + 0.0 AS w_im FROM d"),
        "model_bloch": (_bloch, BLOCH_SQL),
        "bloch_grid": _model("hopf", True),
        "udf_model": (_opaque, f"WITH {grid_sql(N)} SELECT ix, iy, iz, round(sin(kx), 6) + 0.0 AS dx, round(cos(ky), 6) + 0.0 AS dy, round(sin(kz) * cos(kx), 6) + 0.0 AS dz FROM k"),
        "spectrum": (_spectrum, ENERGY + " SELECT ix, iy, iz, round(e_re, 6) + 0.0 AS e_re, round(e_im, 6) + 0.0 AS e_im FROM e"),
        "band_gap": (_gap, ENERGY + " SELECT ix, iy, iz, round(2 * sqrt(e_re * e_re + e_im * e_im), 6) + 0.0 AS gap FROM e"),
        "interior_mask": (_interior, interior_sql(32) + " SELECT iz, count(*) AS points, CAST(sum(ix) AS BIGINT) AS sx, CAST(sum(iy) AS BIGINT) AS sy FROM m GROUP BY iz"),
        "dispersion": (_gradient("e_re", 1), grad("e_re", 1)),
        "im_dispersion": (_gradient("e_im", 2), grad("e_im", 2)),
        "berry_curvature": (_berry, berry_sql()),
        "berry_analytic": (_berry_analytic, BERRY_ANALYTIC),
        "berry_prerequisites": (_prerequisites, f"SELECT true AS valid, {num(GAMMA)} AS gamma, 1 AS gamma_idx, 0 AS d1_idx, 2 AS d2_idx"),
        "fields_volume": (_volume, volume_sql()),
        "field_derivative": (_derivative, derivative_sql()),
        "isosurface_points": (_surface, surface_sql()),
        "idx_to_coord": (_coordinates, coords),
        "interior_points": (_coordinates, coords),
        "silhouette": (_silhouette, interior_sql(32) + " SELECT 'xy' AS plane, ix AS a, iy AS b FROM m UNION SELECT 'xz', ix, iz FROM m UNION SELECT 'yz', iy, iz FROM m"),
        "mask_euler": (_euler, euler_sql()),
        "mask_components": (_components, components_sql()),
        "eigvals_2x2": (_eigen, EIGEN_SQL),
        "eigvals_3x3": (_eigen_3, EIGEN_3),
        "eigvals_nxn": (_eigen_n, None),
        "eigvals_moments": (_moments, moments_sql()),
        "is_hermitian": (_hermitian, f"SELECT {GAMMA} = 0 AS is_hermitian"),
        "is_pt": (_pt, PT_SQL),
        "edge_field_sample": (_sample, sample_sql()),
    }
